"""Fields of business documents as column expressions: finances, equipment, companies, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import contacts, first_of, normalize_date
from .money import claimed_total

_N = r"([\d,]+(?:\.\d+)?)\s*(억원|만원|억|원)?"
#: fixed values: labels of fields, the first pattern that matches decides
FINANCE = {
    "unit_price": [rf"(?:단가|개당)\s*[:=]?\s*{_N}", rf"(?i)unit\s*price\s*[:=]?\s*{_N}"],
    "quantity": [r"(?:수량|qty)\s*[:=]?\s*([\d,]+)()", r"([\d,]+)\s*(?:EA|개|대|세트|본)()(?![가-힣\w])"],
    "amount": [rf"(?:금액|소계)\s*[:=]?\s*{_N}", rf"(?i)amount\s*[:=]?\s*{_N}"],
    "vat": [rf"(?:부가세|VAT)\s*(?:포함|별도)?\s*[:=]?\s*{_N}"],
    "total": [rf"(?:총액|합계|총계)\s*[:=]?\s*{_N}", rf"(?:최종|결제|총|전체)\s*금액\s*[:=]?\s*{_N}"],
}
#: fixed values: kinds of equipment
EQUIPMENT = ("카메라", "렌즈", "조명", "마이크", "믹서", "스위처", "모니터", "삼각대", "DVR", "NVR", "VTR", "CCU", "서버", "스토리지")
#: fixed values: approvals and numbers by their labels
APPROVAL = {
    "approval_date": r"결재일\s*[:\s]*(\d{4}[\.\-]\d{1,2}[\.\-]\d{1,2})",
    "contract_no": r"(?i)계약번호\s*[:\s]*([A-Z0-9\-]+)",
    "doc_no": r"(?i)문서번호\s*[:\s]*([A-Z0-9\-]+)",
    "request_no": r"(?i)품의번호\s*[:\s]*([A-Z0-9\-]+)",
}
#: fixed values: spellings of companies
COMPANY = (r"([가-힣A-Za-z]+)\s*주식회사", r"주식회사\s*([가-힣A-Za-z]+)", r"\(주\)\s*([가-힣A-Za-z]+)", r"([가-힣A-Za-z]+)\s*\(주\)")
#: fixed values: programmes and projects by label or bracket. Here a name ends with its line.
PROJECT = (r"프로그램\s*:\s*([가-힣A-Za-z0-9 \-\_\(\)]+)", r"방송\s*프로그램\s*:\s*([가-힣A-Za-z0-9 \-\_\(\)]+)", r"프로젝트\s*:\s*([가-힣A-Za-z0-9 \-\_\(\)]+)", r"《([^》]+)》", r"【([^】]+)】")


def scaled(number: Column, unit: Column) -> Column:
    """Won of a number with its unit."""
    value = F.try_to_number(F.nullif(F.regexp_replace(number, ",", ""), F.lit("")), F.lit("999999999999D9999")).cast("decimal(20,4)")
    factor = F.when(unit.startswith("억"), 10**8).when(unit.startswith("만"), 10**4).otherwise(1)
    return F.round(value * factor, 0).cast("bigint")


def _field(text: Column, name: str) -> Column:
    return F.coalesce(*[scaled(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)) for p in FINANCE[name]])


def finances(text: Column) -> Column:
    """struct of the fields, amount filled with unit price x quantity where it is missing, and the VAT mode."""
    unit, quantity = _field(text, "unit_price"), _field(text, "quantity")
    mode = F.when(text.rlike("(?i)부가세\\s*포함|VAT\\s*포함"), "included").when(text.rlike("(?i)부가세\\s*별도|VAT\\s*별도"), "excluded").when(text.rlike("면세|영세"), "none").otherwise("unknown")
    return F.struct(unit.alias("unit_price"), quantity.alias("quantity"), F.coalesce(_field(text, "amount"), unit * quantity).alias("amount"), _field(text, "vat").alias("vat"), _field(text, "total").alias("total"), mode.alias("vat_mode"))


def all_of(text: Column, patterns: Sequence[str]) -> Column:
    """What any pattern's group matches, distinct, in the order of the patterns."""
    return F.array_distinct(F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), lambda x: F.trim(x)))


def metadata(text: Column) -> Column:
    """struct of contacts, equipment, projects, companies, approval (a map without nulls), date and total."""
    approval = F.map_from_entries(F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(k), F.regexp_extract(text, p, 1))) for k, p in APPROVAL.items()])))
    day = first_of(text, [r"(\d{4}[-./]\d{1,2}[-./]\d{1,2})", r"(\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일)"])
    return F.struct(contacts(text).alias("contacts"), all_of(text, [f"(?i)({'|'.join(EQUIPMENT)})"]).alias("equipment"), all_of(text, PROJECT).alias("projects"), all_of(text, COMPANY).alias("companies"), approval.alias("approval"), normalize_date(day).alias("date"), claimed_total(text).alias("total"))


def manufacturer(text: Column, aliases: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for alias, name in reversed(aliases.items()):
        out = F.when(F.lower(text).contains(alias), F.lit(name)).otherwise(out)
    return out


def years_in_use(text: Column) -> Column:
    """A number of years from 1 to 30."""
    n = F.try_to_number(F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{1,2})\s*년", 1), F.lit("")), F.lit("99")).cast("int")
    return F.when(n.between(1, 30), n)


def chosen(rule: Column, model: Column, name: str) -> Column:
    """struct value, source, warning: the rule's value before the model's; a warning where they differ."""
    return F.struct(F.coalesce(rule, model).alias("value"), F.when(rule.isNotNull(), "rule").when(model.isNotNull(), "model").alias("source"), F.when(rule.isNotNull() & model.isNotNull() & (rule != model), F.lit(f"{name} differs")).alias("warning"))
