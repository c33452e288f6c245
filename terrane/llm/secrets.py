"""Secrets by how many owners and repositories share them, in SQL expressions only.

Patterns give candidates with their places. Each candidate's digest is counted over
the whole corpus by distinct owners and repositories: what many owners have, or many
repositories of one owner, is an example that was copied around; what few have looks
live. The first kinds are always reported; patterns of the second group, which alone
prove less, are added where the corpus shows them to be their owners' own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .quality import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that is the secret, what else must hold of a match.
BASE: list[tuple[str, str, int, Callable[[Column], Column]]] = [
    ("assign", ASSIGN, 2, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", "AKIA[A-Z0-9]+", 0, lambda m: F.char_length(m) >= 20),
    ("hex", "[0-9a-f]{24,}", 0, lambda m: F.lit(True)),
]
ADDED: list[tuple[str, str, int, Callable[[Column], Column]]] = [
    (
        "provider",
        "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{24,}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}",
        0,
        lambda m: F.lit(True),
    ),
]
BLOCK = 256
SPAN = "array<struct<start: bigint, rank: int, stop: bigint, kind: string, digest: binary>>"


def sums_before(steps: Column) -> Column:
    """Sums of the elements before each one, in blocks, so that many matches stay cheap."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))

    def with_sums(whole: Column) -> Column:
        def with_bases(base: Column) -> Column:
            return F.transform(steps, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + add(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))

        return let(F.transform(whole, lambda x, b: add(F.slice(whole, F.lit(1), b))), with_bases)

    return let(F.transform(blocks, lambda b: add(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))), with_sums)


def spans(text: Column, kind: str, pattern: str, group: int, rank: int, holds: Callable[[Column], Column]) -> Column:
    """Leftmost matches that do not overlap, with places in code points; those that fail ``holds`` go afterwards."""

    def placed(m: Column) -> Column:
        def from_parts(parts: Column) -> Column:
            steps = F.transform(m, lambda x, i: (F.char_length(F.get(parts, i)) + F.char_length(x)).cast("long"))

            def from_steps(st: Column) -> Column:
                def row(x: Column, i: Column, before: Column) -> Column:
                    start = F.get(before, i) + F.char_length(F.get(parts, i))
                    value = F.regexp_extract(x, pattern, group) if group else x
                    return F.struct(
                        start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(x)).alias("stop"), F.lit(kind).alias("kind"), F.when(holds(x), F.unhex(F.md5(value.cast("binary")))).alias("digest")
                    )

                return let(sums_before(st), lambda before: F.transform(m, lambda x, i: row(x, i, before)))

            return let(steps, from_steps)

        return let(F.split(text, pattern, -1), from_parts)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(SPAN)))
    return F.filter(rows.cast(SPAN), lambda s: s["digest"].isNotNull())


def written(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    every = [*BASE, *ADDED]
    found = F.concat(*[spans(F.col("text"), k, p, g, n, h) for n, (k, p, g, h) in enumerate(every)])
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "repository", F.array_sort(found).alias("found"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 2, most_repositories: int = 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, most_owners, most_repositories, live, text_key.

    One row out per row of ``docs`` (doc_id, text, the owner's and the repository's
    column). spans: kind:start:end of all, in code points, by start and then kind. A
    candidate that at most ``most_owners`` distinct owners and ``most_repositories``
    distinct repositories (of an owner) have is live, others are examples; null owners
    count as one owner, apart from empty ones, and so do null repositories. The columns
    most_owners and most_repositories are the largest counts of a document's
    candidates. Base spans are all listed, added ones where they are live. live: the
    live places, an array of (start, stop). A null text is empty; a document without
    candidates has empty spans; rows that repeat, null ids among them, stay rows;
    texts are searched whole. Other columns are ignored, whatever their names; an empty
    table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    rows = ws.save(candidates(docs, owner, repository), "candidates")
    n = len(BASE)
    each = rows.where(F.size("found") > 0).select("doc_id", "text_key", "owner", "repository", F.explode("found").alias("s"))
    who = each.select(F.col("s.digest").alias("digest"), "owner", "repository").distinct()
    owners = who.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    # a table of its own, so that the rows of a widely copied candidate can be dealt to several tasks
    owners = ws.save(owners, "owners")
    known = each.select("doc_id", "text_key", F.col("s").alias("span"), F.col("s.digest").alias("digest")).distinct().join(owners, "digest")
    is_live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    per = known.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.when(is_live, F.col("span"))).alias("live"), F.count_if(~is_live).alias("n_examples"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories")
    )
    mine = per.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "live", "n_examples", "most_owners", "most_repositories")
    out = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = F.array().cast(SPAN)
    base = F.filter("found", lambda s: s["rank"] < n)
    live = F.coalesce(F.col("live").cast(SPAN), none)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat(base, F.filter(live, lambda s: s["rank"] >= n)))
    return out.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"), F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
        F.array_sort(F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))).alias("live"), "text_key",
    )


def redact(text: Column, live: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the places ``live``, sorted, each replaced; places that overlap become one."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        more = F.when(fresh, F.concat(F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.concat(s["done"], more).alias("done"))

    return F.aggregate(live, empty, step, lambda s: F.concat(s["done"], F.substring(text, s["at"].cast("int") + 1, F.char_length(text))))


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 2, most_repositories: int = 20) -> DataFrame:
    """``docs`` with live secrets replaced in ``text``, and ``n_chars``, if there is one, counted anew for them.

    Rows stay, repeated ones and null ids too; null, empty and clean texts stay as they
    are. Columns may have any names. An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "redact")
    found = scan(docs, owner, repository, most_owners, most_repositories).where("n_live > 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "live").distinct()
    places = ws.save(found, "live")
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    both = rows.join(places, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("key")), "left")
    hit = F.col("live").isNotNull()
    clean = both.withColumn("clean", F.when(hit, redact(text, F.col("live"))).otherwise(text))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
