"""Operators of the training-data pipeline against brute force, with odd rows of every kind."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import chat, ctw, decontamination, induced, neardup, packing, quality, repeats, sharding, tokenfile, urlrules
from quern.llm.common import fresh_path, utf8

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sequence_id string, key string, bucket string, label string"


def docs_of(spark, rows):
    """Documents with columns whose names the operators also use inside."""
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", "k", "b", "l") for d, t in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "été", "δοκιμή", "x", "Omega", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(k, " ".join(rng.choice([text(25), rng.choice(shared), rng.choice(shared)[: rng.randint(50, 300)]]) for _ in range(rng.randint(1, 4)))) for k in range(40)]
    return [*rows, (50, None), (51, ""), (52, " \n "), (53, "one"), (54, rows[3][1]), (3, rows[3][1]), (55, "ab" * 300), (56, "a" * 900), (57, text(4000)), (58, "q" * 200), (59, "\t".join(words)), (None, text(30))]


@pytest.fixture(scope="module")
def documents(spark):
    return docs_of(spark, odd_rows())


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids + [end] for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD_TEXTS = ["", " ", "  a", "a ", " a b", "a  b c", "a\n b", "a \nb", "\n\n x y\t z  ", "İ ΑΣ Σ é x ́y", "don't I'll 's <|endoftext|> x", "a  b 　c", "x 12 34,5", "a.", "a,.", "a. b", "a.\nb", "é. x", "—. x", "7 7. a7\n7", "\n", "x y z", "word. Word, it's. 3. 4,", "</w>.", "a\r\nb", "x\x0by"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    import pyarrow as pa

    from quern.llm.tokens import Encoder

    texts = ODD_TEXTS + [t or "" for _, t in odd_rows()]
    data, at = utf8(pa.array(texts))
    encoder = Encoder(vocabulary(name))
    for _ in range(2):  # new pieces, then known ones
        ids, ends = encoder.encode(data, at, 9)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == ids_of(name, texts, 9)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " a", "b.", ", ", "\n", "'s", "\u0301", "İ"]), max_size=8).map("".join)), max_size=6))
def test_ids_are_the_librarys_for_any_text(name, texts):
    import pyarrow as pa

    from quern.llm.tokens import encoder

    data, at = utf8(pa.array([*texts, "a <|endoftext|> b"]))
    ids, ends = encoder(vocabulary(name)).encode(data, at, 9)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == ids_of(name, [*texts, "a <|endoftext|> b"], 9)


def test_ids_are_the_librarys_for_whole_tables():
    import pyarrow.parquet as pq

    from quern.llm.tokens import encoder

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        import pyarrow as pa

        ids, ends = encoder(vocabulary(name)).encode(*utf8(pa.array(texts)), 9)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == ids_of(name, texts, 9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_combinations_use_everything(lengths):
    counts = np.bincount(lengths, minlength=65)
    found = packing.combinations(counts, 64)
    used = Counter()
    for combination, times in found:
        assert times >= 1 and sum(n * k for n, k in combination.items()) <= 64
        for n, k in combination.items():
            used[n] += k * times
    assert used == Counter(lengths)


def test_fullest_is_fullest():
    rng = random.Random(1)
    for _ in range(200):
        counts = np.zeros(41, np.int64)
        for _ in range(rng.randint(0, 8)):
            counts[rng.randint(1, 40)] += 1
        room = rng.randint(0, 40)
        items = [n for n in range(41) for _ in range(counts[n])]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        used = packing.fullest(room, counts)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in used.items())


def test_packing(spark, documents):
    rows = packing.pack(packing.token_pieces(documents, vocabulary("byte_bpe_50k.json"))).toPandas()
    expected = Counter()
    for (d, _), ids in zip(odd_rows(), ids_of("byte_bpe_50k.json", [t or "" for _, t in odd_rows()], 2), strict=True):
        start, first = 0, len(ids) % 1024 or 1024
        for piece in range(-(-len(ids) // 1024)):
            n = first if piece == 0 else 1024
            expected[str(d), piece, start, n, crc(ids[start : start + n])] += 1
            start += n
    key = lambda d: "None" if d != d or d is None else str(int(d))
    assert Counter((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == expected
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 3
    assert packing.pack(packing.token_pieces(documents.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 2000)], "doc_id bigint, piece int, length bigint"))


def test_token_files(spark, documents):
    found = sorted(map(tuple, tokenfile.token_output(documents.filter("doc_id is not null"), vocabulary("word_bpe_49k.json")).collect()))
    rows = sorted(((d, t or "") for d, t in odd_rows() if d is not None), key=lambda r: r[0])
    start, expected = 0, []
    for (d, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert found == sorted(expected)
    path = fresh_path(spark, "tokens")
    import glob

    import pyarrow.parquet as pq

    tokenfile.write_tokens(docs_of(spark, [(k, f"word{k} " * 50) for k in range(3000)]).coalesce(1), path + "-many", vocabulary("word_bpe_49k.json"))
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path.removeprefix('file://')}-many/*.parquet")]
    for f in files:
        for g in range(f.metadata.num_row_groups):
            group = f.metadata.row_group(g)
            assert group.total_byte_size <= 40 << 20
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for name, c in columns.items() if "." not in name) and all(c.has_offset_index for c in columns.values())
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings) and any("DELTA_BINARY_PACKED" in c.encodings for c in columns.values())
    one = tokenfile._files(spark, path + "-many").filter("doc_id = 77").select("n_tokens", "ids")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint,ids:array<int>" in plan and "start_in_file" not in plan.split("ReadSchema", 1)[1]
    assert one.first().ids == ids_of("word_bpe_49k.json", ["word77 " * 50], 1)[0]
    assert "ids" not in tokenfile.read_tokens(spark, path + "-many").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ", 1)[1].split("\n")[0]
    tokenfile.write_tokens(documents.limit(0), path, vocabulary("word_bpe_49k.json"))
    assert tokenfile.checksums(spark, path).count() == 0
    tokenfile.write_tokens(documents.filter("doc_id = 7"), path + "-one", vocabulary("word_bpe_49k.json"))
    assert len(tokenfile.read_tokens(spark, path + "-one").first().ids) == tokenfile.checksums(spark, path + "-one").first().n_tokens


def test_chat(spark):
    turns = [(1, 0, "user", "hi <|text|> \\ | <"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "first"), (2, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 0, "system", "s"), (None, 0, "user", "x"), (4, 0, "user", ""), (4, 1, "assistant", "é日")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, own in by.items():
        own.sort()
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].state == got[4].state == "ok" and got[2].state.startswith("turn 0") and got[3].state.startswith("turn 2")
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<|\\>", max_size=6), st.text(alphabet="ab<|\\>role text", max_size=20)), max_size=4))
def test_chat_round_trip(turns):
    t = chat.Template()
    assert chat.parse("".join(p for p, _ in chat.segments(turns, chat.Machine(t))), t) == turns


def test_chat_machine():
    t = chat.Template()
    for roles, state in (("user assistant", "ok"), ("system user assistant user assistant", "ok"), ("", "ends after start"), ("user", "ends after user"), ("user user", "turn 1: user after user"), ("tool user assistant", "turn 0: tool after start")):
        machine = chat.Machine(t)
        emitted = list(chat.segments([(r, f"{r}!") for r in roles.split()], machine))
        assert machine.state == state
        assert [x for x, loss in emitted if loss] == ["assistant!"] * roles.count("assistant")


def test_sharding(spark, documents):
    layout = sharding.Layout(target=60_000, smallest=1_000, fan_in=3)
    root = fresh_path(spark, "shards")
    for k in range(7):
        sharding.append(documents.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == k).repartition(2), root, layout)
    sharding.compact(spark, root, documents.schema, layout)
    listed = [tuple(r) for r in sharding.manifest(spark, root).collect()]
    assert not sharding.plan(listed, layout) and len(listed) < 14
    kept = sharding.read(spark, root, documents.schema).select("doc_id", "text")
    assert kept.exceptAll(documents.select("doc_id", "text")).count() == 0 and kept.count() == documents.count()
    with pytest.raises(FileExistsError):
        sharding.commit(spark, root, listed, sharding.versions(spark, root)[-1])
    for version in sharding.versions(spark, root):  # old versions stay readable
        assert sharding.read(spark, root, documents.schema, version).count() <= documents.count()
    assert sharding.read(spark, root, documents.schema, 7).count() == documents.count()
    out = sharding.sharded(documents).collect()
    assert sorted(str((r.doc_id, r.text_sha256)) for r in out) == sorted(str((d, None if t is None else hashlib.sha256(t.encode()).hexdigest())) for d, t in odd_rows())
    assert sharding.sharded(documents.limit(0)).count() == 0


def test_sharding_readers_and_races(spark, monkeypatch):
    layout = sharding.Layout(target=60_000, smallest=1_000, fan_in=2)
    root, rows = fresh_path(spark, "shards"), [docs_of(spark, [(k, f"text {k}")]) for k in range(8)]
    for df in rows[:5]:
        sharding.append(df.coalesce(1), root, layout)
    reader, ids = sharding.read(spark, root, rows[0].schema), lambda df: sorted(r.doc_id for r in df.collect())
    sharding.compact(spark, root, rows[0].schema, layout)
    assert ids(reader) == ids(sharding.read(spark, root, rows[0].schema)) == list(range(5))
    assert ids(sharding.read(spark, root, rows[0].schema, 4)) == list(range(4))
    # A writer that is overtaken adds to the version that won.
    real, done = sharding.commit, []

    def overtaken(spark_, root_, shards, version):
        if not done:
            done.append(real(spark_, root_, sharding._listed(spark, root)[1] + sharding._write(rows[6], root, layout), version))
        return real(spark_, root_, shards, version)

    monkeypatch.setattr(sharding, "commit", overtaken)
    sharding.append(rows[5], root, layout)
    assert ids(sharding.read(spark, root, rows[0].schema)) == list(range(7))
    done.clear()
    sharding.append(rows[7], root, layout)
    sharding.compact(spark, root, rows[0].schema, layout)
    monkeypatch.undo()
    found = ids(sharding.read(spark, root, rows[0].schema))
    assert found == [*range(7), 6, 7] or found == [*range(6), 6, 6, 7]
    # Of the versions two are kept, and only their shards.
    assert sharding.vacuum(spark, root, 2) == 0
    last = sharding.versions(spark, root)[-2:]
    assert sharding.vacuum(spark, root, 2, 0.0) > 0 and sharding.versions(spark, root) == last
    assert all(sharding.read(spark, root, rows[0].schema, v).count() for v in last)
    with pytest.raises(ValueError):
        sharding.read(spark, root, rows[0].schema, 1)
    # Other failures are not taken for a race.
    with pytest.raises(Exception) as e:
        sharding.commit(spark, root + "/no\0where", [], 1)
    assert not isinstance(e.value, FileExistsError)
    assert sharding.compact(spark, fresh_path(spark, "none"), rows[0].schema, layout) == 0
    plan = sharding.read(spark, root, rows[0].schema)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#\t\x1c\xa0", max_size=60))
def test_quality_counts(text):
    import re

    assert quality.counts(text)[:5] == brute_counts(text)
    assert quality.counts(text)[5] == sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in text.split("\n"))


def test_quality_fences_lean_on_what_is_above(spark):
    """A source of long words keeps them if it is large; a few such texts among a small source's are judged by what is above it."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(n - 2, n + 2))) for _ in range(60))
    rows = [(k, text(5), "en", "plain") for k in range(600)] + [(1000 + k, text(13), "en", "long") for k in range(1500)] + [(3000 + k, text(5), "en", "small") for k in range(20)] + [(4000, text(30), "en", "small"), (4001, text(5), None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert all(kept[d] for d, *_ in rows if d != 4000)
    alone = {r.doc_id: r.kept for r in quality.judged(docs.filter("source = 'plain' or doc_id >= 4000").unionByName(docs.filter("doc_id between 1000 and 1003"))).collect()}
    assert not any(alone[k] for k in range(1000, 1004)) and all(alone[k] for k in range(600)) and not alone[4000]
    found = quality.with_measures(quality.features(docs)).withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    fences = {r._source: r for r in quality.thresholds(found).collect()}
    assert fences["plain"].mean_word_high < fences["small"].mean_word_high and fences["plain"].mean_word_low < fences["long"].mean_word_low


def test_quality_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = ({r.doc_id: r.kept for r in quality.judged(docs.repartition(n)).collect()} for n in (1, 7))
    assert a == b
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert sum(a[d] == (q == 1) for d, q in labels.items()) >= 0.9 * len(labels)


def test_quality(spark, documents):
    rows = quality.judged(documents).collect()
    expected = Counter((d, *brute_counts(t)) for d, t in odd_rows())
    assert Counter(tuple(r)[:6] for r in rows) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    clean = " ".join(f"word{k}" for k in range(80))
    mixed = docs_of(spark, [(k, clean) for k in range(30)] + [(99, " ".join(f"#w{k}%%%" for k in range(80)))])
    assert {r.doc_id: r.kept for r in quality.judged(mixed).collect()} == {**dict.fromkeys(range(30), True), 99: False}
    assert quality.filtered(mixed).count() == 30 and quality.filtered(mixed).columns == mixed.columns
    assert quality.judged(documents.limit(0)).count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = np.concatenate([[0], *[np.append(rng.integers(1, 5, rng.integers(1, 30)), 0) for _ in range(rng.integers(1, 6))]])
        index = decontamination.FMIndex(text)
        phrases = [tuple(rng.integers(1, 6, rng.integers(1, 5)).tolist()) for _ in range(20)]
        words = np.zeros((20, 10), np.int64)
        for k, p in enumerate(phrases):
            words[k, : len(p)] = p
        lo, hi = index.search(words, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo.tolist(), hi.tolist(), strict=True):
            found = sorted(index.locate(np.arange(a, max(a, b))).tolist())
            assert found == [k for k in range(len(text)) if tuple(text[k : k + len(p)].tolist()) == p]


def brute_hits(rows, items):
    word = lambda t: decontamination.words_of((t or "").encode())
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    for d, t in rows:
        w, hit, found = word(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        yield d, len(w), len(hit), len(found), decontamination.items_sha256(list(found)), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    items = [(1, odd_rows()[0][1][:300]), (2, "Alpha1! beta2"), (3, None), (4, ""), (11, odd_rows()[0][1][:300]), (5, "nothing of this is there at all, it is just ten words long")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    got = Counter(tuple(r) for r in decontamination.report(decontamination.hits(documents, bench)).collect())
    assert got == Counter(brute_hits(odd_rows(), items))
    assert decontamination.hits(documents.limit(0), bench).count() == 0
    assert not decontamination.report(decontamination.hits(documents, bench.limit(0))).filter("contaminated").count()
    left = decontamination.cleaned(documents, bench)
    assert left.columns == documents.columns
    assert not decontamination.report(decontamination.hits(left, bench)).filter("contaminated").count()


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/", "block")]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST", 7)
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "m.example.com", "xexample.com", "com", "a.net", "net", "b.org", "", "e.com.net", "www.example.com.", "é.com"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/en', '/es/1', '/fr/?q', '?a/en/', '#x', '/EN/'])}" for _ in range(300)]
    urls += [None, "", "no url", "://", "x://y://z/en/", "http://example.com/en/"] + ["http://hot.example.com/en/1"] * 100
    pages = spark.createDataFrame([(k, u, "h", "key") for k, u in enumerate(urls)], "page_id bigint, url string, html string, range string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = urlrules.judge(pages, rules)
    assert {r.page_id: tuple(r)[1:] for r in judged.collect()} == {k: brute_verdict(u) for k, u in enumerate(urls)}
    assert judged.count() == len(urls)
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


def elements_of(text):
    b = np.frombuffer((text or "").encode(), np.uint8)
    return neardup.elements(b, np.array([0, len(b)]))[0]


def test_weighted_elements():
    assert len(elements_of("")) == 0 and len(elements_of("a b")) == 1
    assert len(np.unique(elements_of("a b c d e " * 20))) == 96
    assert np.array_equal(elements_of("A b C d e f"), elements_of("a\nB c d  e f"))


def test_signatures_estimate():
    rng = random.Random(4)
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    b = a[:300] + [f"v{k}" for k in range(100)]
    x, y = elements_of(" ".join(a)), elements_of(" ".join(b))
    h = np.concatenate([x, y])
    s = neardup.signatures(h, np.array([0, len(x), len(h)]), 2000)
    assert abs((s[0] == s[1]).mean() - neardup.similarity(x, y)) < 0.05


def near_rows():
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(6):
        base = [f"w{rng.randint(0, 10**5)}" for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.choice([2, 12, 40])):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_near_dedup_against_all_pairs(spark, documents):
    rows = [*odd_rows()[:-1], *[(d + 1000, t) for d, t in near_rows()]]
    df = docs_of(spark, rows)
    own = {d: elements_of(t) for d, t in rows}
    parent = {d: d for d in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(own)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(own[a]) and len(own[b]) and neardup.similarity(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = neardup.classes(df).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == {d: root(d) for d in own}
    kept = neardup.deduplicated(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(d) for d in own}) and kept.columns == df.columns
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.classes(documents).count() == len(odd_rows())


def test_near_dedup_keyed_by_text(spark):
    """One doc_id at several texts, and null ones."""
    rng = random.Random(5)
    base, other = ([f"w{rng.randint(0, 10**6)}" for _ in range(200)] for _ in range(2))
    near = [*base[:50], "changed", *base[51:]]
    a, b, n, more = (" ".join(x) for x in (other, base, near, [*base, "word"]))
    df = docs_of(spark, [(1, a), (1, b), (2, n), (None, more), (None, more), (3, None), (3, ""), (None, "")])
    found = Counter(tuple(r) for r in neardup.classes(df).collect())
    assert found == Counter({(1, 1, 1): 2, (2, 2, 1): 1, (None, None, 1): 2, (3, 3, 3): 2, (None, None, None): 1})
    kept = Counter((r.doc_id, r.text) for r in neardup.deduplicated(df).collect())
    assert kept == Counter([(1, a), (1, b), (3, None), (3, ""), (None, "")])
    rows = docs_of(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (0, "u v w x y z")])
    assert sorted((r.doc_id, r.text[0]) for r in neardup.deduplicated(rows).collect()) == [(0, "u"), (1, "a")]
    assert Counter(tuple(r) for r in neardup.classes(docs_of(spark, [(None, b), (None, n)])).collect()) == Counter({(None, None, None): 2})


def test_components_of_many_edges(spark):
    """Rounds over tables and one task give the same components."""
    from quern.llm.common import Work

    rng = random.Random(6)
    rows = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    edges = spark.createDataFrame(rows, "a bigint, b bigint")
    with Work(spark) as work:
        found = [sorted(map(tuple, neardup.components(edges, work, bound=n).collect())) for n in (0, 10, 10**6)]
        assert neardup.components(edges.limit(0), work) is None
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def test_near_dedup_recall(spark):
    """Shares of the pairs that are found, by similarity: banding finds nearly all pairs at 0.8, and the exact check none below."""
    rng = random.Random(9)
    rows, like = [], []
    for k in range(400):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        own = list(base)
        for place in rng.sample(range(0, 196, 5), rng.randint(1, 9)):
            own[place] = f"n{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
        like.append(neardup.similarity(elements_of(rows[-1][1]), elements_of(rows[-2][1])))
    found = {r.doc_id: r.class_id for r in neardup.classes(docs_of(spark, rows)).collect()}
    caught = [found[2 * k] == found[2 * k + 1] for k in range(400)]
    assert not any(c for c, x in zip(caught, like, strict=True) if x < 0.8)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1)):
        own = [c for c, x in zip(caught, like, strict=True) if low <= x < high]
        assert len(own) > 20 and sum(own) >= 0.99 * len(own)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(1, 5), st.integers(0, 2))
def test_induced_sorting(values, times, limit):
    text = np.append(np.array(values * times), 0).astype(np.int16)
    own = text.tolist()
    expected = sorted(range(len(own)), key=lambda k: own[k:])
    memory = induced.Memory(limit * 100)
    try:
        assert induced.suffix_array(text, 5, memory).tolist() == expected
        s = induced.smaller_than_next(text)
        stars = induced.sorted_stars(text, s, memory)
        order, lcp = induced.induce(text, s, stars, 257, memory, 20, induced.common_prefixes(text, stars, 20))
        assert order.tolist() == expected
    finally:
        memory.close()

    def common(a, b):
        k = 0
        while a + k < len(own) and b + k < len(own) and own[a + k] == own[b + k]:
            k += 1
        return min(k, 20)

    assert lcp.tolist() == [0, *[common(a, b) for a, b in zip(expected, expected[1:], strict=False)]]


def brute_repeats(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    for d, t in rows:
        b, last = (t or "").encode(), 0
        marks = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                marks[max(p, last) : p + 200] = True
                last = p + 200
        kept = bytes(np.frombuffer(b, np.uint8)[~marks])
        spans = int(np.count_nonzero(np.diff(np.append(False, marks).astype(int)) == 1))
        yield d, len(b), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_repeats(spark, documents):
    assert Counter(tuple(r) for r in repeats.report(documents).collect()) == Counter(brute_repeats(odd_rows()))
    assert repeats.report(documents.limit(0)).count() == 0
    left = repeats.cleaned(documents.filter("doc_id is not null"))
    assert left.columns == documents.columns
    expected = {d for d, n, removed, *_ in brute_repeats(odd_rows()) if d is not None and n > removed}
    assert {r.doc_id for r in left.collect()} == expected


def test_repeats_of_an_anchor_with_more_than_a_shard(spark, monkeypatch):
    """Passages of 100 to 199 bytes in all texts, with other bytes around them: no key keeps more than a shard, and nothing is lost."""
    monkeypatch.setattr(repeats, "SHARD", 3000)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages, tails = [text(n) for n in (100, 150, 190, 199)], [text(90) for _ in range(5)]
    rows = [(k, "".join(rng.choice([text(150), rng.choice(tails)]) + p + rng.choice([text(150), rng.choice(tails)]) for p in passages)) for k in range(60)]
    rows += [(100, "ab" * 4000), (101, "a" * 5000), (102, text(300) + "c" * 900), (103, rows[0][1]), (104, rows[1][1][:700])]
    docs = docs_of(spark, rows)
    assert Counter(tuple(r) for r in repeats.report(docs).collect()) == Counter(brute_repeats(rows))
    _, asked = repeats.groups(repeats._keyed(docs))
    assert max(r[0] for r in asked.groupBy("anchor").agg(F.sum(F.col("n") + 199)).select(F.col("sum((n + 199))")).collect()) <= 3000


def test_repeats_without_ids_and_with_clashing_columns(spark):
    text = "".join(f"word{k} " for k in range(100))
    rows = [(None, text), (None, text), (1, text[:400] + "zzz"), (1, "short"), (None, "q" + text[100:])]
    docs = docs_of(spark, rows)
    assert Counter(tuple(r) for r in repeats.report(docs).collect()) == Counter(brute_repeats(rows))
    left = repeats.cleaned(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    found = {(r.doc_id, r.text) for r in left.collect()}
    assert (1, "short") in found and (1, "zzz") in found and (None, "q") in found
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    assert {tuple(r) for r in left.select(*others).collect()} == {tuple(r) for r in docs.select(*others).distinct().collect()}


def test_ctw_adds_up_to_one():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    stream, at = ctw.canonical(data, np.array([0, 4000]))
    codes, counts = np.unique(ctw.grams(stream, at), return_counts=True)
    code = ctw.huffman(np.bincount((codes & np.uint64(255)).astype(int), counts, minlength=256))
    estimate, weight = ctw.weigh(*ctw.fold(codes, counts, code, 1 << 20), 1 << 20)
    for context in (0x616263646561, 0x0A0A0A0A0A0A, 0x7A7A7A7A7A7A):
        every = np.uint64(context << 8 & (1 << 48) - 1) | np.arange(256, dtype=np.uint64)
        p = 10 ** ctw.log10_probability(every, (estimate, weight, code))
        assert p.sum() == pytest.approx(1, abs=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=12), max_size=5))
def test_canonical(texts):
    import pyarrow as pa

    data, at = utf8(pa.array(texts, pa.string())) if texts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    stream, ends = ctw.canonical(data, at)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    assert [bytes(stream[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] == [b" ".join(lower(t).encode().split()) + b"\n" for t in texts]


def test_lm_scoring(spark, documents, monkeypatch):
    import math

    for name, n in (("BLOCK", 3000), ("PIECE", 1000), ("BUCKET", 2000), ("MERGE", 500)):
        monkeypatch.setattr(ctw, name, n)
    rows = odd_rows()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    word = lambda t: (t or "").encode().lower().split() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t).encode().split()
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*word(t), None])
    total, distinct = sum(counts.values()), len(counts)
    expected = {}
    for d, t in rows:
        own = [*word(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        expected[d, len(own)] = (held(d), sum(counts[w] > 0 for w in own), total, pytest.approx(base))
    got = ctw.scored(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == expected[r.doc_id, r.n_tokens]
        assert r.score < 0
    assert ctw.scored(documents.limit(0)).count() == 0


def test_lm_scores_are_of_exact_contexts(spark, monkeypatch):
    """Against a tree of dictionaries that has every node by its own name."""
    import math

    for name, n in (("GRAMS", 200), ("BLOCK", 900), ("PIECE", 300), ("BUCKET", 1000), ("MERGE", 400)):
        monkeypatch.setattr(ctw, name, n)
    rng = random.Random(8)
    rows = [(k, " ".join("".join(rng.choice("abcdeé7") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    streams = {d: (b"\n" * 5 + b" ".join(t.encode().split()) + b"\n") for d, t in rows}
    learned = [b for d, b in streams.items() if zlib.crc32(str(d).encode()) % 10]
    assert 0 < len(learned) < len(rows)
    histogram = np.bincount(np.frombuffer(b"".join(b[5:] for b in learned), np.uint8), minlength=256)
    nodes, bits, _ = ctw.huffman(histogram)
    path = [[(int(n), int(b)) for n, b in zip(nodes[c], bits[c], strict=True) if n >= 0] for c in range(256)]
    seen, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for b in learned:
        for k in range(5, len(b)):
            for node, bit in path[b[k]]:
                for d in range(6):
                    seen[b[k - d : k], node][bit] += 1
                    if d:
                        longer[b[k - d + 1 : k], node].add((b[k - d : k], node))

    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    total, weight = {}, {}
    for key in sorted(seen, key=lambda x: -len(x[0])):
        e = own(*seen[key])
        total[key] = e if len(key[0]) == 5 else float(np.logaddexp(e, sum(total[x] for x in longer[key])) + math.log(0.5))
        weight[key] = 1.0 if len(key[0]) == 5 else math.exp(math.log(0.5) + e - total[key])

    def probability(context, node, bit):
        p = None
        for d in range(5, -1, -1):
            key = context[5 - d :], node
            if key in seen:
                e = (seen[key][1] + 0.5) / (sum(seen[key]) + 1)
                p = e if p is None else weight[key] * e + (1 - weight[key]) * p
        p = 0.5 if p is None else p
        return p if bit else 1 - p

    expected = {d: sum(math.log10(probability(b[k - 5 : k], node, bit)) for k in range(5, len(b)) for node, bit in path[b[k]]) for d, b in streams.items()}
    got = {r.doc_id: r.score for r in ctw.scored(docs_of(spark, rows)).collect()}
    assert got == {d: pytest.approx(x, rel=1e-7) for d, x in expected.items()}


def test_lm_table_grows_with_the_corpus(spark):
    """Every n-gram of all texts has its own row, whatever their number."""
    rows = [(k, f"{zlib.crc32(str(k).encode()):x} {k:x}") for k in range(3000)]
    own = set()
    for _, t in rows:
        b = b"\n" * 5 + t.encode() + b"\n"
        own.update(b[k - 5 : k + 1] for k in range(5, len(b)))
    from quern.llm.common import Work

    with Work(spark) as work:
        found = work.written(ctw._blocks(docs_of(spark, rows).select("doc_id", "text"), 5, 7, 3), "blocks").filter(F.col("kind").isin(ctw.ASKED_GRAMS, ctw.ASKED_WORDS))
        histogram = np.bincount(np.frombuffer(b"".join(g[-1:] for g in own), np.uint8), minlength=256)
        counted = ctw._counts(found, ctw.huffman(histogram), 5, 3).filter(F.col("kind") == ctw.GRAM_COUNTS).select("data").collect()
    codes = np.concatenate([ctw.unpacked(bytes(r.data), np.uint64) for r in counted])
    assert len(codes) == len(np.unique(codes)) == len(own)


def test_model_beats_words_on_held_out_texts(spark):
    rows = ctw.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
