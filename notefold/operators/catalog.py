"""Catalog rows, facets, titles and documents of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions import text as X


def ordered_text(df: DataFrame, key: str, order: list[str], text: str, out: str, sep: str = "\n") -> DataFrame:
    """Texts of a key joined in order, empty and null ones left out."""
    listed = F.array_sort(F.collect_list(F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.struct(*order, F.col(text).alias("_t")))))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), sep).alias(out))


def summary_title(title: Column, body: Column, key: Column, companies: list[str] | None = None, roles: list[str] | None = None, rounds: list[str] | None = None, longest: int = 30) -> Column:
    """The title if it says something, else up to four hints, else the first line that does, else the key."""
    hints = [*(companies or X.COMPANIES), *(roles or X.ROLES), *(rounds or X.ROUNDS)]
    found = F.slice(F.array_compact(F.array(*(F.when(body.contains(h), F.lit(h)) for h in hints))), 1, 4)
    line = F.get(F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"[\r\n]+"), X.strip), X.meaningful), F.lit(0))
    made = F.when(X.meaningful(title), title).when(F.size(found) > 0, F.concat(F.array_join(found, ""), F.lit("面经"))).when(line.isNotNull(), line).otherwise(F.concat(F.lit("无标题面经_"), F.substring(key, 1, 8)))
    return F.substring(X.strip(made), 1, longest)


def light_tags(text: Column) -> Column:
    low = F.lower(text)
    result = F.when(low.contains("offer") | low.contains("oc") | text.contains("已录"), "疑似通过").when(text.contains("挂") | text.contains("拒") | text.contains("凉"), "疑似未通过").otherwise("")
    return F.struct(X.first_hint(text, X.COMPANIES).alias("company"), X.first_hint(text, X.ROLES).alias("position"), X.first_hint(text, X.ROUNDS).alias("round"), result.alias("result"))


def facets(df: DataFrame, columns: list[str], other: str = "未分类") -> DataFrame:
    """(facet, value, n): counts of each value of each column in one pass; null and '' as ``other``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other)).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n")).select("facet", "value", "n")


def markdown(title: Column, body: Column, ocr: Column, fields: dict[str, Column]) -> Column:
    """A note as Markdown with a YAML head; values are quoted as JSON strings, which YAML reads."""
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.when(v.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(v.cast("string").alias("v"))), r'^\{"v":(.*)\}$', "$1"))) for k, v in fields.items()))
    return F.concat_ws("\n", F.lit("---"), head, F.lit("---"), F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), F.coalesce(body, F.lit("")), F.when(F.length(ocr) > 0, F.concat(F.lit("## OCR\n"), ocr)))
