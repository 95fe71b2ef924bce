"""Memory analytics: clusters and consolidation, episodes, conversations, expiry, eviction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.predicates import moment
from tidewater.operators.search import SearchOptions, search
from tidewater.operators.store import EmptyVector, NotFound, RecordError, next_id, unique
from tidewater.plans.components import components
from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import durable

#: Rows of a block in the all-pairs similarity join.
BLOCK = 2048


def similar_pairs(df: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", joined: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of rows, a < b, that are similar enough, by matrix products of blocks.

    With ``joined`` only pairs that join the same rows: each product gives at
    most one for each of its rows, so near-equal vectors do not make all pairs.
    Rows are cut into blocks of about BLOCK; each unordered pair of blocks is one
    row of a shuffle and one product, so memory is two blocks whatever the size.
    For lower-is-better metrics similar means at most 1 - threshold.
    """
    import numpy as np
    import pyarrow as pa

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    n = own.count()
    blocks = max(1, -(-n // BLOCK))
    cell = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # A block meets each block once: the row goes to all pairs (own, other), stored with the smaller first.
    sent = own.withColumn("own", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).select("x", "y", "own", "id", "v")

    def pairs(table: pa.Table) -> pa.Table:
        own, ids = table["own"].to_numpy(), table["id"].to_numpy()
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        v = table["v"].to_pylist()
        width = max(map(len, v))
        m = np.zeros((len(v), width))
        size = np.array([len(r) for r in v])
        for i, r in enumerate(v):
            m[i, : len(r)] = r
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        p, q = m[left], m[right]
        inner = p @ q.T
        fit = size[left][:, None] == size[right][None]
        if metric in ("euclidean", "euclidean_squared"):
            s = np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * inner, 0)
            s = np.where(fit, np.sqrt(s) if metric == "euclidean" else s, 0)
            hit = np.round(s, 6) <= 1 - threshold
        else:
            if metric != "dot":
                norm = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
                inner = np.divide(inner, norm, out=np.zeros_like(inner), where=norm > 0)
            hit = np.round(np.where(fit, inner, 0), 6) >= threshold
        if x == y:
            np.fill_diagonal(hit, False)
        if joined:
            i, j = spanning(hit, x == y)
        else:
            i, j = np.nonzero(np.triu(hit) if x == y else hit)
        a, b = ids[left[i]], ids[right[j]]
        keep = a != b
        a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    def spanning(hit, square: bool):
        """A forest of the pairs of ``hit``: its rows and columns are joined as all pairs join them."""
        seen_row, seen_column = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
        out_i, out_j = [], []
        for start in np.flatnonzero(hit.any(axis=1)):
            if seen_row[start]:
                continue
            seen_row[start] = True
            if square:
                seen_column[start] = True
            todo = np.array([start])
            while len(todo):
                # Rows reach new columns, and the columns new rows; of each new one a single pair is kept.
                reach = hit[todo] & ~seen_column
                columns = np.flatnonzero(reach.any(axis=0))
                if not len(columns):
                    break
                out_i.append(todo[reach[:, columns].argmax(axis=0)])
                out_j.append(columns)
                seen_column[columns] = True
                if square:
                    seen_row[columns] = True
                    todo = columns
                    continue
                back = hit[:, columns] & ~seen_row[:, None]
                todo = np.flatnonzero(back.any(axis=1))
                if not len(todo):
                    break
                out_i.append(todo)
                out_j.append(columns[back[todo].argmax(axis=1)])
                seen_row[todo] = True
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])

    return sent.groupBy("x", "y").applyInArrow(pairs, "a long, b long").distinct()


def cluster_members(df: DataFrame, threshold: float = 0.85, min_size: int = 2, max_size: int = 10, metric: str = "cosine") -> DataFrame:
    """Rows of ``df`` with ``cluster_id`` (least member) and ``rank`` in it by importance.

    Single linkage: components of similar pairs with at least ``min_size``
    rows; the ``max_size`` most important ones stay.  Archived rows and
    summaries take no part.
    """
    for flag in ("archived", "is_consolidation"):
        if flag in df.columns:
            df = df.where(~F.coalesce(F.col(flag), F.lit(False)))
    labels = components(similar_pairs(df, threshold, metric, joined=True))
    if min_size <= 1:
        labels = df.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("full_size")).where(F.col("full_size") >= min_size)
    w = Window.partitionBy("cluster_id").orderBy(F.desc("importance"), F.asc("id"))
    joined = df.join(labels.join(sizes, "label").withColumnRenamed("label", "cluster_id"), "id")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_size)


def centroid(members: DataFrame, by: str) -> DataFrame:
    """Rows ``(by, centroid)``: the mean of the vectors as long as the first member's; others are skipped."""
    first = members.where(F.size("vector") > 0).groupBy(by).agg(F.min_by(F.size("vector"), "id").alias("dim"))
    cells = members.join(first, by).where(F.size("vector") == F.col("dim")).select(by, F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.round("x", 6).alias("x"))))
    return means.groupBy(by).agg(F.transform(ordered, lambda c: c.x).alias("centroid"))


def clusters(df: DataFrame, **options) -> DataFrame:
    """One row a cluster: size, mean and largest importance, time range, member ids, centroid."""
    m = durable(cluster_members(df, **options), "members")
    facts = m.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.max("importance").alias("importance"),
        F.min("created_at").alias("start"), F.max("created_at").alias("end"), F.array_sort(F.collect_list("id")).alias("ids"),
    )
    return facts.join(centroid(m, "cluster_id"), "cluster_id")


def consolidate(df: DataFrame, summarise: Callable[[Column], Column], **options) -> tuple[DataFrame, DataFrame]:
    """The summary rows of the clusters and ``df`` with their members archived.

    ``summarise`` makes a summary from the column of a cluster's contents in id
    order; a summary's importance is the largest of its members.
    """
    m = durable(cluster_members(df, **options), "members")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x.content)
    made = m.groupBy("cluster_id").agg(summarise(parts).alias("content"), F.max("importance").alias("importance"), F.array_sort(F.collect_list("id")).alias("consolidated_from"))
    made = made.join(centroid(m, "cluster_id").withColumnRenamed("centroid", "vector"), "cluster_id").withColumn("is_consolidation", F.lit(True))
    gone = m.select("id", F.lit(True).alias("_gone"))
    kept = df if "archived" in df.columns else df.withColumn("archived", F.lit(False))
    kept = kept.join(gone, "id", "left").withColumn("archived", F.coalesce("_gone", "archived")).drop("_gone")
    return made, kept


def expand(rows: DataFrame, records: DataFrame, ids_col: str, key: str) -> DataFrame:
    """The records a row was made from, in the order of its id list; missing ones are left out."""
    listed = rows.select(key, F.posexplode(ids_col).alias("pos", "id"))
    return listed.join(records, "id").orderBy(key, "pos")


def episodes(df: DataFrame, gap_seconds: float = 1800, min_records: int = 2, max_records: int = 100, per: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with ``episode_id``: runs without a gap beyond ``gap_seconds``, cut at ``max_records``.

    A gap of exactly that length stays inside.  With ``per`` a new value ends a
    run, otherwise runs are global.  Range partitions are scanned in order, and
    only a few numbers of each go through the driver, so no task sees a whole
    run, a whole user or the whole table.
    """
    if "archived" in df.columns:
        df = df.where(~F.coalesce("archived", F.lit(False)))
    runs = _runs(df, gap_seconds, per or [])
    own = runs.withColumn("_chunk", F.floor((F.col("_rank") - F.col("_run")) / max_records))
    # A chunk has max_records rows at most.
    first = F.min_by("id", F.struct("created_at", "id"))
    chunks = own.groupBy("_run", "_chunk").agg(F.concat(F.lit("ep_"), first).alias("episode_id"), F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_records)
    return own.join(chunks, ["_run", "_chunk"]).drop("_run", "_chunk", "_size", "_rank")


def _runs(df: DataFrame, gap_seconds: float, per: list[str]) -> DataFrame:
    """Add ``_rank``, a row's number over the whole table by ``per``, time and id, and ``_run``, the rank of its run's first row."""
    order = [*per, "created_at", "id"]
    ranged = df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_us": F.unix_micros(F.col("created_at").cast("timestamp"))})
    rows = durable(ranged, "ranged")
    w = Window.partitionBy("_part").orderBy(*per, "_us", "id")
    far = F.col("_us") - F.lag("_us").over(w) > int(gap_seconds * 1e6)
    for c in per:
        far |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    local = rows.withColumn("_n", F.row_number().over(w) - 1)
    # The first row of a partition is decided by the driver, which knows the last row before it.
    local = local.withColumn("_start", F.max(F.when((F.col("_n") > 0) & far, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = durable(local, "local-runs")
    key = F.struct(*per, "_us", "id") if per else F.struct("_us", "id")
    edge = F.struct(*(F.xxhash64(c).alias(f"h{i}") for i, c in enumerate(per)), "_us")
    facts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max("_start").alias("last"), F.min_by(edge, key).alias("low"), F.max_by(edge, key).alias("high"))
    bases, base, before, run = [], 0, None, 0
    for r in sorted(facts.collect(), key=lambda r: r["_part"]):
        low, high = tuple(r["low"]), tuple(r["high"])
        if before is None or low[:-1] != before[:-1] or low[-1] - before[-1] > gap_seconds * 1e6:
            run = base
        bases.append((r["_part"], base, run))
        if r["last"] is not None:
            run = base + r["last"]
        base, before = base + r["n"], high
    known = df.sparkSession.createDataFrame(bases, "_part int, _base long, _carried long")
    found = local.join(F.broadcast(known), "_part")  # a row a partition
    return found.withColumns({"_rank": F.col("_base") + F.col("_n"), "_run": F.coalesce(F.col("_base") + F.col("_start"), "_carried")}).drop("_part", "_us", "_n", "_start", "_base", "_carried")


def episode_rows(members: DataFrame) -> DataFrame:
    """One row an episode: record ids in time order, time range, size."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x.id)
    return members.groupBy("episode_id").agg(ids.alias("record_ids"), F.min("created_at").alias("start"), F.max("created_at").alias("end"), F.count(F.lit(1)).alias("size"))


def with_siblings(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Search hits with the other records of their episode (the least one if in several); none is an empty list."""
    own = members.groupBy("id").agg(F.min("episode_id").alias("episode_id"))
    rest = members.select("episode_id", F.col("id").alias("sibling"))
    found = F.broadcast(hits.select("id", "score")).join(own, "id", "left").join(rest, "episode_id", "left")
    other = F.when(F.col("sibling") != F.col("id"), F.col("sibling"))
    return found.groupBy("id", "score", "episode_id").agg(F.array_sort(F.collect_list(other)).alias("siblings"))


def session(turns: DataFrame, session_id: object) -> DataFrame:
    """A conversation's turns in order; a missing turn number is 0."""
    return turns.where(F.col("session_id") == F.lit(session_id)).orderBy(F.coalesce("turn", F.lit(0)), "created_at", "id")


def sessions(turns: DataFrame) -> DataFrame:
    return turns.select("session_id").where("session_id is not null").distinct().orderBy("session_id")


def session_stats(turns: DataFrame) -> DataFrame:
    """Turns, first and last time by turn order, and counts of each role, for each session."""
    at = F.struct(F.coalesce("turn", F.lit(0)), "created_at", "id")
    facts = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("created_at", at).alias("first_at"), F.max_by("created_at", at).alias("last_at"))
    roles = turns.groupBy("session_id", "role").count().groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "count")))).alias("roles"))
    return facts.join(roles, "session_id")


def thread(turns: DataFrame, chunk_id: int) -> DataFrame:
    """All turns of the thread that ``chunk_id`` is in, in time order: its root and whatever descends from it.

    A turn has one parent, so these are the turns that parents in the table
    connect with it; the rounds grow with the logarithm of the longest path.
    """
    edges = turns.select("id", "parent_id").where("parent_id is not null")
    known = turns.select(F.col("id").alias("parent_id")).distinct()
    labels = components(edges.join(known, "parent_id", "left_semi"), "parent_id", "id")
    found = turns.where(F.col("id") == chunk_id).select("id")
    own = labels.where(F.col("id") == chunk_id).select("label").first()
    if own is not None:
        found = found.union(labels.where(F.col("label") == own[0]).select("id"))
    return turns.join(found.distinct(), "id").orderBy("created_at", "id")


def insert_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``turns`` with those of ``new`` (seq, session_id, parent_id, ...), ids from max + 1 in the order of ``seq``.

    A reply's ``thread_root`` is its parent's, or its parent if that has none; a
    parent that is not there leaves it null.  Replies to turns of the same
    batch name them by ``parent_seq``.  A turn without a session raises.
    """
    if not new.where("session_id is null").isEmpty():
        raise RecordError("a turn needs a session")
    if "thread_root" not in turns.columns:
        turns = turns.withColumn("thread_root", F.lit(None).cast("long"))
    start = next_id(turns)
    made = durable(running_total(unique(new, "seq"), [F.col("seq")], name="_n").withColumn("id", (F.col("_n") + start).cast("long")).drop("_n"), "turns")
    if "parent_seq" in made.columns:
        of = made.select(F.col("seq").alias("parent_seq"), F.col("id").alias("_parent"))
        made = made.join(of, "parent_seq", "left").withColumn("parent_id", F.coalesce("_parent", "parent_id")).drop("_parent", "parent_seq")
    made = made.drop("seq", "thread_root")
    old = turns.select(F.col("id").alias("parent_id"), F.coalesce("thread_root", "id").alias("_root"))
    # A chain inside the batch begins with a turn whose parent, if it has one, was there before.
    inside = made.select(F.col("id").alias("parent_id"))
    chains = components(made.select("id", "parent_id").join(inside, "parent_id", "left_semi"), "parent_id", "id").withColumnRenamed("label", "_chain")
    known = made.join(chains, "id", "left").withColumn("_chain", F.coalesce("_chain", "id"))
    tops = known.join(inside, "parent_id", "left_anti").join(old, "parent_id", "left").select("_chain", F.col("id").alias("_top"), "_root")
    rooted = known.join(tops, "_chain", "left")
    root = F.coalesce("_root", F.when(F.col("id") != F.col("_top"), F.col("_top")))
    return turns.unionByName(rooted.withColumn("thread_root", root).drop("_chain", "_top", "_root"), allowMissingColumns=True)


def children(turns: DataFrame) -> DataFrame:
    """Rows ``(id, children)``: the replies of each turn that has some, in id order."""
    return turns.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))


def rooted_thread(turns: DataFrame, chunk_id: int) -> DataFrame:
    """:func:`thread` of turns that know their ``thread_root``: a filter instead of a walk; raises NotFound without the turn."""
    own = turns.where(F.col("id") == chunk_id).select(F.coalesce("thread_root", "id")).first()
    if own is None:
        raise NotFound(f"turn {chunk_id}")
    return turns.where((F.col("id") == own[0]) | (F.col("thread_root") == own[0])).orderBy("created_at", "id")


def delete_session(turns: DataFrame, session_id: object) -> DataFrame:
    return turns.where(~F.coalesce(F.col("session_id") == F.lit(session_id), F.lit(False)))


def remember(df: DataFrame, new: DataFrame, now: datetime, importance: float = 0.5, ttl_hours: float | None = None) -> DataFrame:
    """``df`` with memories ``(seq, content, vector, tags, ...)``: importance 0.5 and no expiry unless given."""
    if not new.where(F.coalesce(F.size("vector"), F.lit(0)) <= 0).isEmpty():
        raise EmptyVector("a memory needs a vector")
    expires = F.timestamp_micros(F.unix_micros(moment(now).cast("timestamp")) + int((ttl_hours or 0) * 3.6e9)) if ttl_hours else F.lit(None).cast("timestamp")
    made = new.withColumns({"importance": F.lit(importance), "created_at": moment(now), "updated_at": moment(now), "expires_at": expires.cast("timestamp_ntz"), "access_count": F.lit(0)})
    start = next_id(df)
    made = running_total(unique(made, "seq"), [F.col("seq")], name="_n").withColumn("id", (F.col("_n") + start).cast("long")).drop("_n", "seq")
    return df.unionByName(made, allowMissingColumns=True)


def forget(df: DataFrame, now: datetime, only_expired: bool = False, older_than: timedelta | None = None, below: float | None = None, tags: list[str] | None = None) -> DataFrame:
    """``df`` without the memories that meet every given condition; at least one is needed."""
    conditions = []
    if only_expired:
        conditions.append(expired(now))
    if older_than is not None:
        conditions.append(F.col("created_at") < moment(now - older_than))
    if below is not None:
        conditions.append(F.col("importance") < below)
    if tags:
        conditions.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if not conditions:
        raise RecordError("forgetting needs a condition")
    return df.where(~reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions)))


def create_episode(episodes: DataFrame, records: DataFrame, ids: list[int], title: str) -> DataFrame:
    """``episodes`` (episode_id, title, record_ids, start, end, size, centroid) with one of the listed records, in time order.

    Raises NotFound if one of them is not there.
    """
    own = records.where(F.col("id").isin(ids))
    found = {r[0] for r in own.select("id").collect()}  # at most the ids that the caller listed
    if set(ids) - found:
        raise NotFound(f"records {sorted(set(ids) - found)}")
    number = (episodes.agg(F.max(F.regexp_extract("episode_id", "^ep_([0-9]+)$", 1).try_cast("long"))).first()[0] or 0) + 1
    made = own.withColumn("episode_id", F.lit(f"ep_{number}"))
    rows = episode_rows(made).join(centroid(made, "episode_id"), "episode_id").withColumn("title", F.lit(title))
    return episodes.unionByName(rows.select(*episodes.columns))


EPISODE = "episode_id string, title string, record_ids array<bigint>, start timestamp_ntz, end timestamp_ntz, size bigint, centroid array<double>"


def get_episode(episodes: DataFrame, episode_id: str) -> DataFrame:
    found = episodes.where(F.col("episode_id") == episode_id)
    if found.isEmpty():
        raise NotFound(f"episode {episode_id}")
    return found


def list_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("seconds", F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))).orderBy("start", "episode_id")


def delete_episode(episodes: DataFrame, episode_id: str) -> DataFrame:
    get_episode(episodes, episode_id)
    return episodes.where(F.col("episode_id") != episode_id)


def record_episode(episodes: DataFrame, record_id: int) -> DataFrame:
    """The episode of a record, the least if it is in several; no rows if in none."""
    return episodes.where(F.array_contains("record_ids", record_id)).orderBy("episode_id").limit(1)


def search_episodes(episodes: DataFrame, q: Sequence[float], limit: int = 10, metric: str = "cosine") -> DataFrame:
    """Episodes by the score of their centroid; those of another length are skipped, and a limit of 0 or less means 10."""
    own = episodes.where(F.size("centroid") == len(q)).selectExpr("*", "episode_id AS id", "centroid AS vector")
    return search(own, q, SearchOptions(k=limit if limit > 0 else 10, metric=metric)).drop("id", "vector")


def with_expiry(df: DataFrame, now: datetime, ttl_seconds: Column | None = None) -> DataFrame:
    """``expires_at`` on insert: an explicit time wins, else now + ttl."""
    ttl = F.lit(None).cast("timestamp") if ttl_seconds is None else F.timestamp_micros(F.unix_micros(moment(now).cast("timestamp")) + (ttl_seconds.cast("double") * 1e6).cast("long"))
    kind = df.schema["expires_at"].dataType
    return df.withColumn("expires_at", F.coalesce("expires_at", ttl.cast(kind)))


def expired(now: datetime) -> Column:
    return F.coalesce(moment(now) > F.col("expires_at"), F.lit(False))


def cleanup_expired(df: DataFrame, now: datetime) -> DataFrame:
    return df.where(~expired(now))


def count_expired(df: DataFrame, now: datetime) -> DataFrame:
    return df.agg(F.count_if(expired(now)).alias("expired"))


def evicted(df: DataFrame, max_records: int, policy: str = "fifo", batch: int | None = None) -> DataFrame:
    """The rows that a limit evicts: the first min(excess, batch) by policy, less archived ones, which use up quota.

    fifo: oldest; lru: never accessed, then longest ago; importance: least,
    then oldest.  The batch defaults to a tenth of the limit.
    """
    excess = df.count() - max_records
    n = min(excess, batch if batch and batch > 0 else max(1, max_records // 10))
    if max_records <= 0 or n <= 0:
        return df.limit(0)
    order = {
        "lru": [F.col("last_accessed_at").asc_nulls_first()],
        "importance": [F.col("importance").asc(), F.col("created_at").asc()],
    }.get(policy, [F.col("created_at").asc()])
    out = first_rows(df, [*order, F.col("id")], n)
    return out.where(~F.coalesce("archived", F.lit(False))) if "archived" in df.columns else out


def enforce_limit(df: DataFrame, max_records: int, policy: str = "fifo", batch: int | None = None) -> DataFrame:
    """``df`` without the evicted rows, whose ids are broadcast only if the planner finds them small."""
    return df.join(evicted(df, max_records, policy, batch).select("id"), "id", "left_anti")


#: Up to so many first rows are kept in a heap by each task; more are found by their number in the order.
HEAP_ROWS = 100_000


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, however many they are."""
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    return running_total(df, order, name="_place").where(F.col("_place") < n).drop("_place")


def set_flag(df: DataFrame, ids: list[int], flag: str, value: bool) -> DataFrame:
    """Archive or unarchive rows by id."""
    old = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    return df.withColumn(flag, F.when(F.col("id").isin(ids), F.lit(value)).otherwise(old))


def flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


