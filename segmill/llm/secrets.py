"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base patterns mark assignments, access keys and hex strings. The method then takes candidates (values of
assignments, and long runs of key characters, each with a letter and a digit), hashes them, and counts over the
whole corpus in how many repositories and with how many owners each hash occurs. A candidate of few owners and few
repositories is marked as live, one that is widely copied, within an owner or beyond, as an example. Base spans stay as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 and more: what AKIA begins is a whole run, so a shorter one can't hide a match
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "live", "example")
ASSIGN_LEAST = 6
VALUE_LEAST = 8
MAX_OWNERS = 2
MAX_REPOSITORIES = 10
#: Matches whose places are summed in one go; sums of longer lists go part by part.
_PART = 512
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, value) of a pattern's leftmost non-overlapping matches, in code points; value is the group's."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = matches if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"), values.alias("v"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["b"]).alias("skip"), F.length(x["m"]).alias("n"), x["v"].alias("v")))
    spans = "array<struct<start: int, end: int, value: string>>"
    empty = F.expr(f"cast(array() as {spans})")

    def placed(part: Column, at: Column) -> Column:
        """The matches of a part that begins at a place."""

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["skip"]
            hit = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))
            return F.struct((start + x["n"]).alias("at"), F.array_append(acc["out"], hit).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def joined(all_: Column) -> Column:
        """Parts one after the other, so that appending costs little whatever the number of matches."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _PART).cast("int")), lambda i: F.slice(all_, i * _PART + 1, F.lit(_PART)))
        length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["skip"] + x["n"])
        both = lambda acc, part: F.struct((acc["at"] + length(part)).alias("at"), F.concat(acc["out"], placed(part, acc["at"])).alias("out"))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), both, lambda acc: acc["out"])

    # the list is bound to a name first, as it would be made anew for each part
    got = F.when(F.size(matches) <= _PART, placed(sizes, F.lit(0))).otherwise(F.element_at(F.transform(F.array(sizes), joined), 1))
    return F.when(F.size(matches) > 0, got).otherwise(empty)


def _spans(found: str, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def text_of(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row for each row of docs: the id, base and added (arrays of start, kind number, end; code points, end exclusive).

    An id is a repository of its owner; null owners are one owner, null ids one repository. A candidate is live with at most
    max_owners distinct owners and max_repositories distinct repositories in the whole corpus, else an example. Null texts count as empty and have no spans.
    Repeated rows give repeated rows; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    d = d.select("id", "owner", _found(F.col("text"), ASSIGN, 2).alias("assign"), _found(F.col("text"), ACCESS).alias("access"), _found(F.col("text"), HEX).alias("hex"), _found(F.col("text"), r"(?<![A-Za-z0-9+/_-])" + RUN).alias("runs"))
    d = d.withColumn("assign", F.filter("assign", lambda x: F.length(x["value"]) >= ASSIGN_LEAST))
    values = F.transform(F.filter("assign", lambda x: F.length(x["value"]) >= VALUE_LEAST), lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    mixed = lambda x: x["value"].rlike("[A-Za-z]") & x["value"].rlike("[0-9]")
    cands = F.array_distinct(F.filter(F.concat(values, "runs"), mixed))
    cands = F.transform(cands, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["value"].cast("binary"), 256).alias("hash")))
    base = F.concat(_spans("assign", 0), _spans("access", 1), _spans("hex", 2))
    # written once, so that the number of a row is the same wherever it is used
    d = materialize(d.select(F.monotonically_increasing_id().alias("row"), "id", "owner", base.cast(_SPANS).alias("base"), cands.alias("cands")), "secrets")

    hits = d.where(F.size("cands") > 0).select("row", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "owner", F.explode("cands").alias("c")).select("row", "id", "owner", "c.*")
    uses = hits.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("id").alias("repositories"), F.count("*").alias("n"))
    kind = F.when((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories), 3).otherwise(4)
    uses = materialize(uses.select("hash", kind.alias("kind"), "n"), "uses")
    marked = spread_join(hits.drop("id", "owner"), uses, "hash").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).cast(_SPANS).alias("added"))
    none = F.expr(f"cast(array() as {_SPANS})")
    return d.join(marked, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("added", none).alias("added"))
