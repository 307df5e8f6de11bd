"""Secret scans judged by who else holds the same string.

Patterns find candidates. Their hashes are counted over the corpus by distinct repository
and owner: a string that many owners or repositories hold is a copied example, one that a
single owner holds in few places looks like a live credential. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.store import written


@dataclass(frozen=True)
class Kind:
    """Strings that ``pattern`` finds from left to right, none reaching into another.

    ``group`` is the part that is the secret itself; a match whose group has fewer than
    ``least`` characters is dropped after it was found.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# Patterns every scan reports. A run of at least n characters is found alike
# by a pattern that asks for n and by one that finds every run.
BASE_KINDS = (
    Kind(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: strings that count only when one owner holds them: long, with digits and many characters
OWNED = Kind("owned", r"[A-Za-z0-9+_-]{20,}")
_LEAST_DIGITS = 3
_LEAST_LETTERS = 3
_LEAST_DIFFERENT = 10
KINDS = (*BASE_KINDS, OWNED)
#: a string held by more owners, or in more repositories, is an example
MOST_OWNERS = 1
MOST_REPOSITORIES = 3
#: strings with this share of all finds are looked up in a broadcast of at most so many
_HOT = 1000


def _finds(text: Column, number: int, kind: Kind) -> Column:
    """kind, place, gap (characters since the find before), size, value size, hash.

    Finds and the pieces between them come from one pattern, so lengths give positions.
    """
    pattern = F.lit(kind.pattern)
    parts = F.arrays_zip(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)),
    )

    def described(part: Column, place: Column) -> Column:
        value = part["2"]
        serious = F.lit(True)
        if kind is OWNED:
            serious = (
                (F.regexp_count(value, F.lit("[0-9]")) >= _LEAST_DIGITS)
                & (F.regexp_count(value, F.lit("[A-Za-z]")) >= _LEAST_LETTERS)
                & (F.size(F.array_distinct(F.split(value, ""))) >= _LEAST_DIFFERENT)
            )
        return F.struct(
            F.lit(number).alias("kind"),
            place.alias("place"),
            F.length(part["0"]).cast("bigint").alias("gap"),
            F.length(part["1"]).cast("bigint").alias("size"),
            ((F.length(value) >= kind.least) & serious).alias("holds"),
            F.md5(value.cast("binary")).alias("hash"),
        )

    found = F.transform(parts, described)
    # the piece after the last find has no find
    return F.when(
        text.rlike(kind.pattern), F.slice(found, F.lit(1), F.size(found) - 1)
    ).otherwise(F.slice(found, 1, 0))


def scanned(docs: DataFrame, owner: str, repository: str, text: str, keep: list[str]) -> DataFrame:
    """One written row per row of ``docs``: its number, kept columns, and finds."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        *(F.col(f"`{name}`") for name in keep),
        F.col(f"`{owner}`").cast("string").alias("__owner"),
        F.col(f"`{repository}`").cast("string").alias("__repository"),
        body.alias("__text"),
    )
    finds = F.concat(*(_finds(F.col("__text"), n, kind) for n, kind in enumerate(KINDS)))
    return written(
        rows.select(
            *(F.col(f"`{name}`") for name in keep),
            "__owner",
            "__repository",
            finds.alias("__finds"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "secrets-scanned",
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Finds as rows with start and end (code points, end exclusive); failing ones go.

    Only rows with finds come here; a window sees the finds of one kind in one text.
    """
    one = rows.select("__row", "__owner", "__repository", F.inline("__finds"))
    so_far = (
        Window.partitionBy("__row", "kind")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return (
        one.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("size"))
        .where("holds")
        .select("__row", "__owner", "__repository", "kind", "start", "end", "hash")
    )


def ownership(finds: DataFrame) -> DataFrame:
    """Per hash: n_finds, n_owners and n_repositories (of each owner, added up).

    Three aggregates, each with a map-side part: a string in a third of all texts sends one
    row per owner and repository, then one per owner. Null owners are one owner.
    """
    return (
        finds.groupBy("hash", "__owner", "__repository")
        .agg(F.count("*").alias("n_finds"))
        .groupBy("hash", "__owner")
        .agg(F.sum("n_finds").alias("n_finds"), F.count("*").alias("n_repositories"))
        .groupBy("hash")
        .agg(
            F.sum("n_finds").alias("n_finds"),
            F.sum("n_repositories").alias("n_repositories"),
            F.count("*").alias("n_owners"),
        )
    )


def _with_owners(finds: DataFrame, owners: DataFrame) -> DataFrame:
    """``finds`` with the counts of their hash.

    A hash with a thousandth of all finds or more meets a broadcast, of at most a thousand
    rows since the shares add up to one; the others are joined by hash, no task with more.
    """
    total = owners.agg(F.sum("n_finds").alias("n")).first()["n"] or 0
    frequent = F.col("n_finds") * _HOT >= F.lit(total)
    hot = F.broadcast(owners.where(frequent))
    met = finds.join(hot, "hash")
    rest = finds.join(hot.select("hash"), "hash", "left_anti")
    return met.unionByName(rest.join(owners.where(~frequent), "hash"))


def secret_spans(rows: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """__row, kind (place in ``KINDS``), start, end, hash, n_owners, n_repositories and owned
    of the finds of ``scanned`` rows that are reported.

    Finds of the kind "owned" are reported when their string is one owner's and no base find
    of the text reaches into them.
    """
    finds = written(_placed(rows.where(F.size("__finds") > 0)), "secrets-finds")
    owners = written(ownership(finds), "secrets-owners")
    owned = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = _with_owners(finds, owners).withColumn("owned", owned)
    by_start = Window.partitionBy("__row").orderBy("start", "kind")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    after = by_start.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") < len(BASE_KINDS)
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0))
    coming = F.min(F.when(base, F.col("start"))).over(after)
    free = (reached <= F.col("start")) & F.coalesce(coming >= F.col("end"), F.lit(True))
    return (
        judged.withColumn("free", free)
        .where(base | (F.col("owned") & F.col("free")))
        .drop("free", "__owner", "__repository", "n_finds")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    written_out = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
    )
    return F.array_join(written_out, ",")


def secret_scan(
    docs: DataFrame,
    owner: str,
    repository: str,
    doc_id: str = "doc_id",
    text: str = "text",
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned and n_copied per row.

    spans lists kind:start:end of all reported finds by start, then kind, comma-joined;
    base_sha256 is the SHA-256 of the same list of base finds alone. n_owned counts reported
    finds whose string at most ``most_owners`` owners hold in at most ``most_repositories``
    repositories, n_copied the others.

    A null text counts as an empty one: no finds, and the hash of the empty list. Null owners
    are one owner, null repositories one repository of their owner. Rows that repeat an id
    are rows of their own; rows that repeat everything share a repository. Other columns are
    dropped, whatever their names; an empty table gives an empty result. A text is read
    once, in whole, and does not move; its finds do.
    """
    named = docs.withColumnRenamed(doc_id, "__doc") if doc_id == "__row" else docs
    keep = "__doc" if doc_id == "__row" else doc_id
    rows = scanned(named, owner, repository, text, [keep])
    spans = secret_spans(rows, most_owners, most_repositories)
    base = F.col("kind") < len(BASE_KINDS)
    listed = F.struct("start", "kind", "end")
    per_row = spans.groupBy("__row").agg(
        *(F.count_if(F.col("kind") == n).alias(f"n_{k.name}") for n, k in enumerate(BASE_KINDS)),
        F.sort_array(F.collect_list(F.when(base, listed))).alias("base"),
        F.sort_array(F.collect_list(listed)).alias("every"),
        F.count_if("owned").alias("owned"),
        F.count_if(~F.col("owned")).alias("copied"),
    )
    ids = rows.select("__row", F.col(f"`{keep}`").alias("doc_id"))
    none = F.lit(0).cast("bigint")
    return ids.join(per_row, "__row", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{kind.name}", none).alias(f"n_{kind.name}") for kind in BASE_KINDS),
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("every")), F.lit("")).alias("spans"),
        F.coalesce("owned", none).alias("n_owned"),
        F.coalesce("copied", none).alias("n_copied"),
    )
