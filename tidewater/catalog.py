"""Databases of record collections: catalog, metadata, insert forms, spaces, and versions on disk.

A collection's records are one DataFrame; a mutation makes the next one.  With a
root folder each collection is a :class:`~tidewater.sources.files.Snapshot` under
it and :meth:`Database.sync` writes what changed; without one, a database lives
in memory.  Times are passed in, so the same calls give the same tables.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.predicates import Filter, moment
from tidewater.operators import ann, fusion, graph, memory, search, store, text
from tidewater.operators.search import SearchOptions
from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import drop_path, durable, exists
from tidewater.sources.files import Snapshot

#: Columns that every collection has; payload columns come beside them.
RECORD = (
    "id long, vector array<float>, vectors map<string,array<float>>, content string, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "expires_at timestamp_ntz, importance double, access_count long, last_accessed_at timestamp_ntz"
)
OWN = [c.split()[0] for c in RECORD.replace("map<string,array<float>>", "map").split(", ")]

#: Mutations after which a collection's plan is cut by a written table.
CUT_AFTER = 16

Embedder = Callable[[Column], Column]

# Output dimensions of public embedding models.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "nomic-embed-text": 768,
    "mxbai-embed-large": 1024,
    "snowflake-arctic-embed": 1024,
    "snowflake-arctic-embed2": 1024,
    "all-minilm": 384,
    "all-minilm-l6-v2": 384,
    "bge-m3": 1024,
    "bge-large": 1024,
    "granite-embedding": 384,
    "embeddinggemma": 768,
    "qwen3-embedding": 1024,
}


def model_dimensions(model: str) -> int | None:
    """Dimensions of a known embedding model, whatever its case and tag; None for others."""
    return MODEL_DIMENSIONS.get(model.partition(":")[0].lower())


@dataclass(frozen=True)
class Profile:
    """What made a space's vectors; vectors of another profile do not fit in."""

    provider: str = ""
    model: str = ""
    dimension: int = 0
    metric: str = ""

    @property
    def empty(self) -> bool:
        return self == Profile()

    def fits(self, other: Profile) -> bool:
        """Whether all that both name agrees."""
        return all(a == b for a, b in zip(asdict(self).values(), asdict(other).values(), strict=True) if a and b)


@dataclass(frozen=True)
class Space:
    """A named vector space; dimension 0 is set by its first vector."""

    dimension: int = 0
    metric: str = "cosine"
    profile: Profile | None = None


@dataclass(frozen=True)
class CollectionOptions:
    """How a collection works; dimension 0 is set by the first vector."""

    dimension: int = 0
    metric: str = "cosine"
    text_fields: tuple[str, ...] = ()
    spaces: dict[str, Space] = field(default_factory=dict)
    profile: Profile | None = None
    max_records: int = 0
    policy: str = "fifo"
    batch: int = 0


@dataclass
class Metrics:
    """How often, and how long on average, operations were called."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, seconds: float) -> None:
        self.counts[name] = self.counts.get(name, 0) + 1
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds

    def snapshot(self) -> dict[str, tuple[int, float]]:
        return {k: (n, self.seconds[k] / n) for k, n in self.counts.items()}


class Collection:
    """One table of records with its options, metadata and next identifier."""

    def __init__(self, db: Database, name: str, options: CollectionOptions, records: DataFrame | None = None, next_id: int = 1, metadata: dict | None = None):
        self.db, self.name, self.options, self.next_id = db, name, options, next_id
        self.records = records if records is not None else db.spark.createDataFrame([], RECORD)
        self.metadata, self.embedder, self.changes = dict(metadata or {}), None, 0
        self.text_index: text.TextIndex | None = None
        self.cells: ann.CellIndex | None = None

    # Facts.

    @property
    def dimension(self) -> int:
        return self.options.dimension

    @property
    def metric(self) -> str:
        return self.options.metric

    def count(self) -> int:
        return self.records.count()

    def stats(self) -> DataFrame:
        """One row: name, counts, dimension, metric."""
        facts = store.collection_stats(self.records).drop("dimension")
        return facts.select(F.lit(self.name).alias("name"), "*", F.lit(self.dimension).alias("dimension"), F.lit(self.metric).alias("metric"))

    def validate(self) -> DataFrame:
        return store.validate(self.records)

    def set_metadata(self, values: dict) -> None:
        self._open()
        self.metadata = dict(values)

    def set_metadata_value(self, key: str, value: object) -> None:
        self._open()
        self.metadata[key] = value

    def delete_metadata_value(self, key: str) -> None:
        self._open()
        self.metadata.pop(key, None)

    # Spaces.

    def add_space(self, name: str, space: Space = Space()) -> None:
        """A new named space; the default one is always there."""
        self._open()
        if name in ("", "default") or name in self.options.spaces:
            raise store.SpaceExists(name)
        self.options = replace(self.options, spaces={**self.options.spaces, name: space})

    def has_space(self, name: str) -> bool:
        return name in ("", "default") or name in self.options.spaces

    def spaces(self) -> DataFrame:
        """Rows ``(space, count, dimension, metric)`` of all spaces, the default one first, then by name."""
        known = [("default", self.dimension, self.metric, 0), *((k, s.dimension, s.metric, 1) for k, s in sorted(self.options.spaces.items()))]
        facts = self.db.spark.createDataFrame(known, "space string, dimension int, metric string, place int")
        counts = store.space_stats(self.records)
        return facts.join(counts, "space", "left").select("space", F.coalesce("count", F.lit(0)).alias("count"), "dimension", "metric", "place").orderBy("place", "space").drop("place")

    def set_profile(self, profile: Profile, space: str = "default") -> None:
        """Record what makes a space's vectors; raises if it contradicts what is known."""
        self._open()
        if not self.has_space(space):
            raise store.SpaceNotFound(space)
        main = space in ("", "default")
        old = self.options.profile if main else self.options.spaces[space].profile
        known = self.dimension if main else self.options.spaces[space].dimension
        if old is not None and not old.fits(profile) or known and profile.dimension and known != profile.dimension:
            raise store.ProfileMismatch(f"{space}: {profile}")
        if main:
            self.options = replace(self.options, profile=profile)
        else:
            self.options = replace(self.options, spaces={**self.options.spaces, space: replace(self.options.spaces[space], profile=profile)})

    # Inserts.

    def insert(self, rows: DataFrame, now: datetime, importance: float | None = None, ttl: timedelta | None = None, expires_at: datetime | None = None) -> DataFrame:
        """Add rows ``(seq, vector, ...)`` in the order of ``seq`` and return them with their ids.

        Columns ``importance``, ``ttl_seconds``, ``expires_at`` and ``content``
        of a row come before the arguments; an explicit time before a ttl.  All
        or nothing: an empty vector, or one of another length, adds no row.
        """
        self._open()
        if not rows.where(F.coalesce(F.size("vector"), F.lit(0)) <= 0).isEmpty():
            raise store.EmptyVector(self.name)
        return self._add(rows, now, importance, ttl, expires_at)

    def insert_documents(self, rows: DataFrame, now: datetime, **options) -> DataFrame:
        """Add rows ``(seq, content, [vector], ...)``; a document may have no vector."""
        self._open()
        return self._add(rows if "vector" in rows.columns else rows.withColumn("vector", F.lit(None).cast("array<float>")), now, **options)

    def insert_text(self, rows: DataFrame, now: datetime, **options) -> DataFrame:
        """Add rows ``(seq, content, ...)`` with the embedder's vectors."""
        return self.insert(rows.withColumn("vector", self._embedded()(F.col("content"))), now, **options)

    def insert_records(self, rows: DataFrame, now: datetime) -> DataFrame:
        """Add or replace rows ``(seq, id, vectors, ...)`` with vectors in named spaces; '' and 'default' mean the main one.

        A null id or 0 gets the next free one.  A replaced record keeps times of
        creation and expiry, importance and accesses, and loses the vectors
        that are not given again.  Unknown spaces raise.
        """
        self._open()
        full = F.map_filter(F.coalesce("vectors", F.create_map().cast("map<string,array<float>>")), lambda k, v: F.size(v) > 0)
        rows = rows.withColumn("vectors", full)
        named = {r[0]: (r[1], r[2]) for r in rows.select(F.explode("vectors").alias("k", "v")).groupBy("k").agg(F.min(F.size("v")), F.max(F.size("v"))).collect()}  # a row a space
        for k, sizes in named.items():
            if not self.has_space(k):
                raise store.SpaceNotFound(k)
            self._fit(k, *sizes)
        main = F.coalesce(F.try_element_at("vectors", F.lit("default")), F.try_element_at("vectors", F.lit("")))
        rows = rows.withColumns({"vector": main.cast("array<float>"), "vectors": F.map_filter("vectors", lambda k, v: ~k.isin("", "default"))})
        rows = rows.withColumn("vectors", F.when(F.size("vectors") > 0, F.col("vectors")))
        unnamed = F.coalesce(F.col("id"), F.lit(0)) == 0
        given = store.unique(rows.where(~unnamed), "id")
        top = max(self.next_id, (given.agg(F.max("id")).first()[0] or 0) + 1)
        made = self._numbered(rows.where(unnamed).drop("id"), top)
        old = self.records.select("id", *(F.col(c).alias(f"_{c}") for c in ("created_at", "expires_at", "importance", "access_count", "last_accessed_at")))
        kept = given.drop("seq").join(old, "id", "left")
        known = F.col("_created_at").isNotNull()
        kept = kept.withColumns({
            "created_at": F.coalesce("_created_at", moment(now)), "updated_at": moment(now), "expires_at": F.when(known, F.col("_expires_at")),
            "importance": F.coalesce("_importance", F.lit(0.0)), "access_count": F.coalesce("_access_count", F.lit(0).cast("long")), "last_accessed_at": F.when(known, F.col("_last_accessed_at")),
        }).drop(*(f"_{c}" for c in ("created_at", "expires_at", "importance", "access_count", "last_accessed_at")))
        new = durable(self._stamped(made, now).unionByName(kept, allowMissingColumns=True), "records")
        self.next_id = max(self.next_id, (new.agg(F.max("id")).first()[0] or 0) + 1)
        self._set(self.records.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True), "insert")
        return new

    def set_record_vector(self, record_id: int, space: str, vector: Sequence[float]) -> None:
        """One record's vector in one space."""
        self._open()
        store.get(self.records, record_id)
        if not self.has_space(space):
            raise store.SpaceNotFound(space)
        if not len(vector):
            raise store.EmptyVector(space)
        self._fit(space, len(vector), len(vector))
        value = F.array(*map(F.lit, map(float, vector))).cast("array<float>")
        which = F.col("id") == record_id
        if space in ("", "default"):
            self._set(store.update(self.records, which, {"vector": value}), "update")
        else:
            self._set(store.set_space_vector(self.records, which, space, value), "update")

    # Changes.

    def update(self, record_id: int, values: dict[str, Column], now: datetime) -> None:
        """Replace values of one record; raises NotFound without it."""
        self._open()
        store.get(self.records, record_id)
        self._set(store.update(self.records, F.col("id") == record_id, {**values, "updated_at": moment(now)}), "update")

    @property
    def payload(self) -> list[str]:
        """The columns that records have beside the common ones."""
        return [c for c in self.records.columns if c not in OWN]

    def update_payload(self, record_id: int, values: dict[str, Column], now: datetime) -> None:
        """One record's payload as a whole: columns that are not given become null."""
        self.update(record_id, {**{c: F.lit(None).cast(self.records.schema[c].dataType) for c in self.payload}, **values}, now)

    def update_vector(self, record_id: int, vector: Sequence[float], now: datetime) -> None:
        """One record's main vector, which must have the collection's length."""
        self.set_record_vector(record_id, "default", vector)
        self.update(record_id, {}, now)

    def upsert(self, rows: DataFrame, columns: list[str]) -> None:
        """Replace ``columns`` of the records with the ids of ``rows``, or add them; a null id or 0 gets the next free one."""
        self._open()
        self._set(durable(store.upsert_by_id(self.records, rows, columns), "upsert"), "upsert")
        self.next_id = max(self.next_id, store.next_id(self.records))

    def upsert_texts_by_key(self, rows: DataFrame, key: str) -> None:
        """Replace the content of the records with the same ``key``, or add them; a replaced text loses its vectors."""
        bare = rows.withColumns({"vector": F.lit(None).cast("array<float>"), "vectors": F.lit(None).cast("map<string,array<float>>")})
        self.upsert_by_key(bare, key, ["content", "vector", "vectors"])

    def upsert_by_key(self, rows: DataFrame, key: str, columns: list[str]) -> None:
        """Replace ``columns`` of the record with the same value of ``key``, or add one."""
        self._open()
        self._set(durable(store.upsert_by_key(self.records, rows, key, columns), "upsert"), "upsert")
        self.next_id = max(self.next_id, store.next_id(self.records))

    def delete(self, record_id: int) -> None:
        self._open()
        store.get(self.records, record_id)
        self._set(self.records.where(F.col("id") != record_id), "delete")

    def delete_where(self, *filters: Filter) -> int:
        """Delete what passes all filters, nothing without one, and return how many that were."""
        self._open()
        n = store.find(self.records, *filters).count() if filters else 0
        self._set(store.delete_where(self.records, *filters), "delete")
        return n

    def clear(self) -> None:
        """No records; the next identifier goes on."""
        self._open()
        self._set(self.db.spark.createDataFrame([], self.records.schema), "delete")

    def reset(self) -> None:
        """No records, and identifiers from 1 again."""
        self.clear()
        self.next_id = 1

    def cleanup_expired(self, now: datetime) -> int:
        """Delete expired records; schedule it where a cleaner is wanted."""
        n = memory.count_expired(self.records, now).first()[0]
        self._set(memory.cleanup_expired(self.records, now), "delete")
        return n

    # Reads.

    def get(self, record_id: int) -> DataFrame:
        return store.get(self.records, record_id)

    def get_vector(self, record_id: int) -> list[float]:
        return list(store.get(self.records, record_id).select("vector").first()[0] or [])

    def for_each(self, call: Callable[[Row], bool | None]) -> None:
        """Call for each record, a partition at a time on the driver, until a call returns False."""
        for row in self.records.toLocalIterator():
            if call(row) is False:
                return

    def iterate(self, offset: int = 0, limit: int | None = None) -> Iterator[Row]:
        """Records by ascending id."""
        return store.page(self.records, offset, limit).toLocalIterator()

    def search(self, q: Sequence[float], o: SearchOptions | None = None, track_at: datetime | None = None) -> DataFrame:
        """The nearest records; with ``track_at`` the whole window counts as accessed then."""
        start = time.monotonic()
        o = o or SearchOptions(metric=self.metric)
        if self.dimension and len(q) != self.dimension:
            raise store.DimensionMismatch(f"{len(q)} numbers where {self.dimension} are expected")
        hits = search.search(self.records, q, o)
        if track_at is not None:
            window = search.search(self.records, q, replace(o, offset=0, limit=None, k=o.window))
            self._set(durable(search.track_access(self.records, window, track_at), "accesses"), "track")
        self.db.metrics.add("search", time.monotonic() - start)
        return hits

    def search_space(self, space: str, q: Sequence[float], o: SearchOptions | None = None) -> DataFrame:
        if not self.has_space(space):
            raise store.SpaceNotFound(space)
        main = space in ("", "default")
        return search.search_space(self.records, space, q, o or SearchOptions(metric=self.metric if main else self.options.spaces[space].metric))

    def search_text(self, words: str, o: SearchOptions | None = None) -> DataFrame:
        """Search by the embedder's vector of a text."""
        q = self.db.spark.range(1).select(self._embedded()(F.lit(words)).alias("q")).first()[0]
        return self.search(list(q), o)

    def search_stream(self, q: Sequence[float], o: SearchOptions | None = None) -> Iterator[Row]:
        """Any k records that pass filters and threshold, as they are found, without an order."""
        return search.unordered(self.records, q, o or SearchOptions(metric=self.metric)).toLocalIterator()

    def explain(self, q: Sequence[float], o: SearchOptions | None = None) -> dict:
        """How a search runs: records, those that pass filters and threshold, and the plan."""
        return search.explain(self.records, q, o or SearchOptions(metric=self.metric))

    def text_search(self, query: str, **options) -> DataFrame:
        return text.text_search(self.records, query, ["content", *self.options.text_fields], **options)

    def hybrid(self, q: Sequence[float], query: str, **options) -> DataFrame:
        return fusion.hybrid(self.records, q, query, ["content", *self.options.text_fields], **options)

    # Indexes.

    def index_text(self, folder: str) -> text.TextIndex:
        """An index on disk of the content and the text fields, as they are now; later inserts are added to it."""
        self.text_index = text.TextIndex(self.db.spark, folder, ["content", *self.options.text_fields]).add(self.records)
        return self.text_index

    def index_vectors(self, folder: str) -> ann.CellIndex:
        """Cells on disk of the main vectors, as they are now; later inserts are added to them."""
        self.cells = ann.CellIndex.build(self.records, folder, self.metric)
        return self.cells

    @property
    def has_index(self) -> bool:
        return self.cells is not None

    # How it is done.

    def _open(self) -> None:
        if self.db.read_only or self.db.closed:
            raise store.ReadOnly(self.db.path or ":memory:")

    def _embedded(self) -> Embedder:
        if self.embedder is None:
            raise store.NoEmbedder(self.name)
        return self.embedder

    def _fit(self, space: str, least: int, most: int) -> None:
        """Check vector lengths of a space; its first vector sets the dimension."""
        main = space in ("", "default")
        own = self.options if main else self.options.spaces[space]
        expected = own.dimension or (own.profile.dimension if own.profile else 0) or least
        if least != expected or most != expected:
            raise store.DimensionMismatch(f"{space or 'default'}: {least} to {most} numbers where {expected} are expected")
        if main:
            self.options = replace(self.options, dimension=expected)
        else:
            self.options = replace(self.options, spaces={**self.options.spaces, space: replace(own, dimension=expected)})

    def _numbered(self, rows: DataFrame, top: int) -> DataFrame:
        if "seq" not in rows.columns:
            raise store.RecordError("rows need a column seq that orders them")
        return running_total(store.unique(rows, "seq"), [F.col("seq")], name="_n").withColumn("id", (F.col("_n") + top).cast("long")).drop("_n", "seq")

    def _stamped(self, rows: DataFrame, now: datetime, importance: float | None = None, ttl: timedelta | None = None, expires_at: datetime | None = None) -> DataFrame:
        """``rows`` with the bookkeeping of new records."""
        lacks = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
        micros = F.unix_micros(moment(now).cast("timestamp"))
        seconds = F.coalesce(lacks("ttl_seconds", "double").cast("double"), F.lit(ttl.total_seconds() if ttl else None).cast("double"))
        at = F.coalesce(lacks("expires_at", "timestamp_ntz").cast("timestamp_ntz"), moment(expires_at) if expires_at else F.lit(None).cast("timestamp_ntz"))
        lived = F.timestamp_micros(micros + (F.when(seconds > 0, seconds) * 1e6).cast("long")).cast("timestamp_ntz")
        return rows.withColumns({
            "created_at": moment(now).cast("timestamp_ntz"), "updated_at": moment(now).cast("timestamp_ntz"), "expires_at": F.coalesce(at, lived),
            "importance": F.coalesce(lacks("importance", "double").cast("double"), F.lit(0.0 if importance is None else importance)), "access_count": F.lit(0).cast("long"),
        }).drop("ttl_seconds")

    def _add(self, rows: DataFrame, now: datetime, importance: float | None = None, ttl: timedelta | None = None, expires_at: datetime | None = None) -> DataFrame:
        some = F.size("vector") > 0
        sizes = rows.where(some).agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if sizes[0] is not None:
            self._fit("default", *sizes)
        new = self._stamped(self._numbered(rows, self.next_id), now, importance, ttl, expires_at)
        new = durable(new.withColumn("vector", F.col("vector").cast("array<float>")), "inserted")
        self.next_id = max(self.next_id, store.next_id(new))
        self._set(self.records.unionByName(new, allowMissingColumns=True), "insert")
        if self.text_index is not None:
            self.text_index.add(new.select("id", *(c if c in new.columns else F.lit(None).cast("string").alias(c) for c in self.text_index.fields)))
        if self.cells is not None:
            self.cells.add(new)
        return new

    def _set(self, records: DataFrame, what: str) -> None:
        start = time.monotonic()
        if self.options.max_records and what in ("insert", "upsert"):
            records = memory.enforce_limit(records, self.options.max_records, self.options.policy, self.options.batch)
        self.changes += 1
        if self.changes % CUT_AFTER == 0:
            records = durable(records, "collection")
        self.records = records
        self.db.metrics.add(what, time.monotonic() - start)


@dataclass
class KnowledgeGraph:
    """Entities and relationships of one name; see :mod:`tidewater.operators.graph`."""

    entities: DataFrame
    edges: DataFrame

    def add_entities(self, new: DataFrame) -> None:
        self.entities = graph.add_entities(self.entities, new)

    def update_entity(self, node: object, values: dict[str, Column]) -> None:
        self.entities = graph.update_entity(self.entities, node, values)

    def delete_entity(self, node: object) -> None:
        graph.get_entity(self.entities, node)
        self.entities, self.edges = graph.delete_entity(self.entities, self.edges, node)

    def add_relationships(self, new: DataFrame) -> None:
        self.edges = durable(graph.add_relationships(self.entities, self.edges, new), "edges")

    def delete_relationship(self, edge: object) -> None:
        self.edges = graph.delete_relationship(self.edges, edge)

    def traverse(self, start: Sequence, t: graph.Traversal = graph.Traversal()) -> tuple[DataFrame, DataFrame]:
        return graph.traverse(self.entities, self.edges, start, t)

    def stats(self) -> DataFrame:
        return graph.stats(self.entities, self.edges)


@dataclass
class EpisodeStore:
    """Episodes of one name; see :mod:`tidewater.operators.memory`."""

    episodes: DataFrame

    def create(self, records: DataFrame, ids: list[int], title: str) -> None:
        self.episodes = durable(memory.create_episode(self.episodes, records, ids, title), "episodes")

    def detect(self, records: DataFrame, **options) -> None:
        """Add the episodes of records (id, vector, created_at); those that are there stay."""
        found = durable(memory.episodes(records, **options), "found")
        rows = memory.episode_rows(found).join(memory.centroid(found, "episode_id"), "episode_id", "left")
        own = rows.withColumn("title", F.lit(None).cast("string")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
        self.episodes = durable(self.episodes.unionByName(own.select(*self.episodes.columns)), "episodes")

    def get(self, episode_id: str) -> DataFrame:
        return memory.get_episode(self.episodes, episode_id)

    def list(self) -> DataFrame:
        return memory.list_episodes(self.episodes)

    def delete(self, episode_id: str) -> None:
        self.episodes = memory.delete_episode(self.episodes, episode_id)

    def search(self, q: Sequence[float], limit: int = 10) -> DataFrame:
        return memory.search_episodes(self.episodes, q, limit)


class Database:
    """Collections by name; ``path`` None keeps them in memory."""

    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False):
        self.spark, self.path, self.read_only, self.closed = spark, path.rstrip("/") if path else None, read_only, False
        self.metadata: dict = {}
        self.metrics = Metrics()
        self._collections: dict[str, Collection] = {}
        self._graphs: dict[str, KnowledgeGraph] = {}
        self._stores: dict[str, EpisodeStore] = {}
        self.reload()

    def create_collection(self, name: str, options: CollectionOptions = CollectionOptions()) -> Collection:
        """A new collection; raises if the name is taken."""
        self._open()
        if name in self._collections:
            raise store.CollectionExists(name)
        self._collections[name] = Collection(self, name, options)
        return self._collections[name]

    def collection(self, name: str, options: CollectionOptions = CollectionOptions()) -> Collection:
        """The collection with this name, made if there is none."""
        return self._collections[name] if name in self._collections else self.create_collection(name, options)

    def get_collection(self, name: str) -> Collection:
        if name not in self._collections:
            raise store.NotFound(f"collection {name}")
        return self._collections[name]

    def has_collection(self, name: str) -> bool:
        return name in self._collections

    def drop_collection(self, name: str) -> None:
        self._open()
        self.get_collection(name)
        del self._collections[name]
        if self.path and exists(self.spark, f"{self.path}/{name}"):
            drop_path(self.spark, f"{self.path}/{name}")

    def create_graph(self, name: str, key: str = "long") -> KnowledgeGraph:
        """The knowledge graph with this name, made empty if there is none."""
        if name not in self._graphs:
            self._open()
            entities = self.spark.createDataFrame([], f"id {key}, type string, name string")
            edges = self.spark.createDataFrame([], f"id {key}, src {key}, dst {key}, type string, weight double, bidirectional boolean")
            self._graphs[name] = KnowledgeGraph(entities, edges)
        return self._graphs[name]

    def get_graph(self, name: str) -> KnowledgeGraph:
        if name not in self._graphs:
            raise store.NotFound(f"graph {name}")
        return self._graphs[name]

    def create_episode_store(self, name: str) -> EpisodeStore:
        """A new empty store; one with this name is replaced."""
        self._open()
        self._stores[name] = EpisodeStore(self.spark.createDataFrame([], memory.EPISODE))
        return self._stores[name]

    def get_episode_store(self, name: str) -> EpisodeStore:
        if name not in self._stores:
            raise store.NotFound(f"episode store {name}")
        return self._stores[name]

    def collections(self) -> list[str]:
        return sorted(self._collections)

    def set_metadata(self, values: dict) -> None:
        self._open()
        self.metadata = dict(values)

    def set_metadata_value(self, key: str, value: object) -> None:
        self._open()
        self.metadata[key] = value

    def delete_metadata_value(self, key: str) -> None:
        self._open()
        self.metadata.pop(key, None)

    def stats(self) -> DataFrame:
        """A row for each collection, as :meth:`Collection.stats`, and one named null for all of them."""
        schema = "name string, count long, vector_count long, text_only long, dimension int, metric string"
        each = self.spark.createDataFrame([], schema)
        for name in self.collections():
            each = each.unionByName(self._collections[name].stats())
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("count", "vector_count", "text_only")]
        return each.unionByName(each.agg(*total), allowMissingColumns=True)

    def sync(self) -> None:
        """Write what changed since the last time: a new version of each such collection, then the catalog."""
        self._open()
        if self.path is None:
            return
        for name, c in self._collections.items():
            if c.changes or not exists(self.spark, f"{self.path}/{name}"):
                Snapshot(self.spark, f"{self.path}/{name}").save(c.records)
                c.records, c.changes = Snapshot(self.spark, f"{self.path}/{name}").load(), 0
        rows = [(name, json.dumps(asdict(c.options)), json.dumps(c.metadata), c.next_id) for name, c in sorted(self._collections.items())]
        rows.append((None, "", json.dumps(self.metadata), 0))
        Snapshot(self.spark, f"{self.path}/_catalog").save(self.spark.createDataFrame(rows, "name string, options string, metadata string, next_id long").coalesce(1))

    def reload(self) -> None:
        """The state that was last written; embedders are set anew by their users."""
        if self.path is None or not exists(self.spark, f"{self.path}/_catalog"):
            return
        self._collections = {}
        for r in Snapshot(self.spark, f"{self.path}/_catalog").load().collect():  # a row a collection
            if r["name"] is None:
                self.metadata = json.loads(r["metadata"])
                continue
            o = json.loads(r["options"])
            profile = lambda p: Profile(**p) if p else None
            spaces = {k: Space(s["dimension"], s["metric"], profile(s["profile"])) for k, s in o["spaces"].items()}
            options = CollectionOptions(**{**o, "spaces": spaces, "profile": profile(o["profile"]), "text_fields": tuple(o["text_fields"])})
            self._collections[r["name"]] = Collection(self, r["name"], options, Snapshot(self.spark, f"{self.path}/{r['name']}").load(), r["next_id"], json.loads(r["metadata"]))

    def close(self) -> None:
        """Write what changed and take no more changes."""
        if not self.closed and not self.read_only:
            self.sync()
        self.closed = True

    def _open(self) -> None:
        if self.read_only or self.closed:
            raise store.ReadOnly(self.path or ":memory:")
