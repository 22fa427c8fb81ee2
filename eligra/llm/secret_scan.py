"""Secrets found by pattern and judged by how many repositories and owners of the corpus hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligra.llm.common import fresh
from eligra.session import materialize

# The base patterns, in the order in which equal starts are listed. (pattern, group that holds the value, least length of it)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}+", 0, 32),
}
#: A token with a digit that no base pattern covers; kept as ``owned`` only by what the corpus says of its value.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,}+"
KINDS = [*BASE, "owned"]


def _found(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap, long, value): characters between the last match and this one, length of the match, its value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"), values.alias("v")), lambda r: F.struct(
        F.length(r["g"]).alias("gap"), F.length(r["h"]).alias("long"), r["v"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), rows)


def live_looking(value: Column) -> Column:
    """Letters and digits, twelve characters or more, eight of them different: not a word, a placeholder or a counter."""
    return ((F.length(value) >= 12) & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
            & (F.size(F.array_distinct(F.split(value, ""))) >= 8))


def _strong(value: Column) -> Column:
    """Random enough to be a credential without a keyword in front: 20 characters of all three classes, twelve different."""
    return ((F.length(value) >= 20) & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]"))
            & (F.size(F.array_distinct(F.split(value, ""))) >= 12))


def ownership(found: DataFrame, max_owners: int) -> DataFrame:
    """Distinct repositories and owners of each value, by its hash: counts are combined before every shuffle, so a value that a third of all
    documents hold is one row for each task. ``copied`` values have more than ``max_owners`` owners."""
    by_repo = found.groupBy("value_hash", "owner", "repo").agg(F.max("by_pattern").alias("by_pattern"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("n"), F.max("by_pattern").alias("by_pattern"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.max("by_pattern").alias("known")).withColumn(
        "copied", F.col("n_owners") > max_owners)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
          repo_col: str | None = "lang", max_owners: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id and rid (hash of text, owner and repository) of every row. spans, for each distinct row: doc_id, rid,
    kind (place in KINDS), start, end (code points, end exclusive), value_hash, live, n_owners, n_repos, copied.

    Base matches stay whatever their value; ``owned`` ones are added: tokens beside every base match that fewer owners than
    an example hold and that are random enough, or equal the value of a base match elsewhere.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    owner = docs[owner_col].cast("string")
    repo = F.concat_ws("\x00", owner, docs[repo_col].cast("string")) if repo_col else owner
    slim = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), owner.alias("owner"), repo.alias("repo"))
    patterns = [*[(p, g) for p, g, _ in BASE.values()], (TOKEN, 0)]
    rows = materialize(slim.select("doc_id", F.xxhash64("text", "owner", "repo").alias("rid"), "owner", "repo",
                                   *[_found(F.col("text"), p, g).alias(f"k{i}") for i, (p, g) in enumerate(patterns)]))
    some = rows.where(" or ".join(f"k{i} is not null" for i in range(len(patterns)))).dropDuplicates(["doc_id", "rid"])
    each = (some.select("doc_id", "rid", "owner", "repo", F.inline(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("hits")) for i in range(len(patterns))])))
        .select("doc_id", "rid", "owner", "repo", "kind", F.posexplode("hits").alias("pos", "hit"))
        .select("doc_id", "rid", "owner", "repo", "kind", "pos", "hit.*"))
    order = Window.partitionBy("doc_id", "rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in BASE.values()], F.lit(0)), F.col("kind") + 1)
    each = (each.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(order)).withColumn("start", F.col("end") - F.col("long"))
            .where(F.length("value") >= least))
    base = F.col("kind") < len(BASE)
    # A token that touches a base match is part of it: look at the furthest end before and the nearest start behind.
    by_start = Window.partitionBy("doc_id", "rid").orderBy("start", "kind")
    each = (each.withColumn("before", F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("behind", F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing)))
            .where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end"))))
            .where(base | live_looking(F.col("value"))))
    each = materialize(each.select("doc_id", "rid", "owner", "repo", "kind", "start", "end", F.sha2("value", 256).alias("value_hash"),
                                   base.alias("by_pattern"), live_looking(F.col("value")).alias("live"), _strong(F.col("value")).alias("strong")))
    judged = each.join(ownership(each, max_owners), "value_hash")
    judged = judged.where(F.col("by_pattern") | (~F.col("copied") & (F.col("strong") | F.col("known"))))
    return rows.select("doc_id", "rid"), judged.select("doc_id", "rid", "kind", "start", "end", "value_hash", "live", "n_owners", "n_repos", "copied")


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (owner-specific, live-looking), n_copied.

    Null and empty texts have no span; null owners count as one owner, null ids are kept. Rows equal in id, text and owner
    give equal rows. Other columns are not read. An empty table gives no rows.
    """
    rows, found = spans(docs, **options)
    entry = F.struct("start", "kind", "end", "live", "copied")
    by_row = found.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(entry)).alias("s")).select(
        F.col("doc_id").alias("d"), F.col("rid").alias("r"), "s")
    out = rows.join(by_row, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["rid"] == F.col("r")), "left")
    s = F.coalesce("s", F.array().cast(by_row.schema["s"].dataType))

    def count(test) -> Column:
        return F.size(F.filter(s, test)).cast("long")

    def of_kind(i: int):
        return lambda x: x["kind"] == i

    return out.select(rows["doc_id"], *[count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)],
                      F.sha2(_joined(F.filter(s, lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), _joined(s).alias("spans"),
                      count(lambda x: x["live"] & ~x["copied"]).alias("n_live"), count(lambda x: x["copied"]).alias("n_copied"))


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every owner-specific secret in its text replaced by ``mask``; widely copied examples stay, and so do all rows.

    Spans of one text that overlap are one. All other columns are returned as they are.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    owner_col, repo_col = options.get("owner_col", "source"), options.get("repo_col", "lang")
    _, found = spans(docs, **options)
    d, r, cut, rid = fresh(docs, "d_", "r_", "cut_", "rid_")
    hit = found.where("not copied").groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    # Gaps between merged spans: (from, length), the last one open.
    run = Window.partitionBy("doc_id", "rid").orderBy("start", "end")
    flat = hit.select("doc_id", "rid", F.inline("s"))
    flat = flat.withColumn("reach", F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    flat = flat.withColumn("group", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(run))
    merged = flat.groupBy("doc_id", "rid", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    last = F.lag("end", 1, 0).over(Window.partitionBy("doc_id", "rid").orderBy("start"))
    keep = merged.withColumn("from", last).groupBy("doc_id", "rid").agg(
        F.sort_array(F.collect_list(F.struct("from", (F.col("start") - F.col("from")).alias("long")))).alias("pieces"), F.max("end").alias("tail"))
    keep = materialize(keep.select(F.col("doc_id").alias(d), F.col("rid").alias(r), F.struct("pieces", "tail").alias(cut)))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    owner = docs[owner_col].cast("string")
    repo = F.concat_ws("\x00", owner, docs[repo_col].cast("string")) if repo_col else owner
    marked = docs.withColumn(rid, F.xxhash64(text, owner, repo))
    out = marked.join(keep, marked[id_col].eqNullSafe(keep[d]) & (marked[rid] == keep[r]), "left")
    t = out[text_col].cast("string")
    clean = F.concat(F.array_join(F.transform(F.col(cut)["pieces"], lambda p: F.concat(F.substr(t, p["from"] + 1, p["long"]), F.lit(mask))), ""),
                     F.substr(t, F.col(cut)["tail"] + 1))
    return out.select(*[F.when(F.col(cut).isNull(), marked[c]).otherwise(clean).alias(c) if c == text_col else marked[c] for c in docs.columns])
