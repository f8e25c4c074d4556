"""Line dedup: levelled sorted runs of line hashes; each batch merge-anti-joins the runs and adds its own.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Of a key of at least `min_chars`
code points that several documents hold, only the lines in the smallest doc_id holding it stay.

Each text is read and hashed once, into a table that is partitioned by batch. Documents come in batches of ascending
doc_id, so a key that a run holds was seen in a smaller document. A run is a bucketed table of (h1, h2, first): 128 bits
of key hash and the smallest doc_id, sorted within each bucket. A batch's distinct keys are hashed into the same
buckets, so the merge join reads the runs as they lie, with no exchange. Keys that no run holds form the batch's own run
on level 0; `fanout` runs of a level are merged into one run of the next. Hot keys meet only in minima and counts,
which combine before the exchange.

Runs may be kept in a folder: a later call on further documents goes on from there, and lines whose keys an earlier call
held in another document go.

Cases: a null or empty text is one empty line and stays. Rows with one doc_id are one holder: none takes lines from
the other, and each row is returned. A null doc_id counts as larger than any other. Keys too short stay always.
An empty table gives an empty result. Extra columns are carried along, whatever their names; columns that have the
names of the results (kept_text, n_lines, n_dropped) are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exists, lower_ascii, new_path, release, remove, written

SPACE = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1
RESULTS = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _hashes(text: Column, min_chars: int) -> Column:
    """One entry for each line: its key's hash, or null where the key is too short."""
    keys = F.transform(lines_of(text), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, _hashed(k)))


class Runs:
    """The levelled runs. add() takes distinct keys that no run holds; seen() joins keys to all runs.

    Without a folder they go with drop(). With one, save() names the runs in a manifest there, one more file each time,
    and the next Runs on that folder begins with those of the last manifest; runs that no manifest names are ignored.
    """

    COLUMNS = "h1 BIGINT, h2 BIGINT, first BIGINT"

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None, path: str | None = None):
        self.spark, self.fanout, self.path = spark, fanout, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]
        self.saves, self.old = 0, []
        if path and exists(spark, f"{path}/manifest"):
            rows = spark.read.schema("save int, level int, at string, buckets int").json(f"{path}/manifest").collect()  # a row for each run
            self.saves = max((r["save"] for r in rows), default=0)
            for r in sorted((r for r in rows if r["save"] == self.saves and r["at"]), key=lambda r: r["level"]):
                self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
                self.levels[r["level"]].append((self._table(r["at"], r["buckets"]), r["at"]))
                self.buckets = r["buckets"]

    def _table(self, at: str, buckets: int) -> str:
        table = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({self.COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{at}'")
        return table

    def _write(self, df: DataFrame) -> tuple[str, str]:
        at = f"{self.path}/run-{uuid.uuid4().hex}" if self.path else new_path(self.spark, "line-run")
        table = self._table(at, self.buckets)
        df.select("h1", "h2", "first").repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").write.insertInto(table)
        return table, at

    def add(self, keys: DataFrame) -> None:
        self.levels[0].append(self._write(keys))

    def compact(self) -> None:
        """Before a batch: a level of `fanout` runs becomes one run of the next level. Their keys are disjoint."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self._union(level))
                for table, path in level:
                    self.spark.sql(f"DROP TABLE {table}")
                    # runs that a manifest names stay until the next one is there
                    self.old.append(path) if self.path else remove(self.spark, path)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def _union(self, runs: list[tuple[str, str]]) -> DataFrame:
        out = self.spark.table(runs[0][0])
        for table, _ in runs[1:]:
            out = out.unionByName(self.spark.table(table))
        return out

    def seen(self, keys: DataFrame) -> DataFrame:
        """keys(h1, h2, ...) with the column `old`: the first holder that a run names, else null. One merge join a run."""
        out = keys.withColumn("old", F.lit(None).cast("long"))
        for level in self.levels:
            for table, _ in level:
                run = self.spark.table(table).withColumnRenamed("first", "run_first")
                out = out.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("old", F.coalesce("old", "run_first")).drop("run_first")
        return out

    def save(self) -> None:
        if self.path:
            rows = [(self.saves + 1, k, at, self.buckets) for k, level in enumerate(self.levels) for _, at in level]
            rows = rows or [(self.saves + 1, None, None, None)]
            self.spark.createDataFrame(rows, "save int, level int, at string, buckets int").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
            self.saves += 1
            for path in self.old:
                remove(self.spark, path)
            self.old = []

    def drop(self) -> None:
        """Forgets the tables; without a folder their files go too."""
        for table, path in (r for level in self.levels for r in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if not self.path:
                remove(self.spark, path)
        self.levels = [[]]


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """Upper ends of all batches but the last, so that each holds about as many documents."""
    at = [k / batches for k in range(1, batches)]
    got = ids.agg(F.percentile_approx("id", F.array(*map(F.lit, at)), 1000).alias("q")).first()["q"] if at else None
    return sorted(set(got or []))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, hot_share: float = 1e-4, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with the columns kept_text, n_lines, n_dropped. path: a folder to go on from, and to keep the runs in.

    A batch grows with the input, so the runs are read `batches` times in all and work is linear in the input.
    A key of more than `hot_share` of a batch's lines (100 at least) is hot: there are at most 1/hot_share of these, so they are broadcast; all other keys meet their documents in a shuffled join.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    pairs = docs.select(_row_id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    bounds = _bounds(pairs.select("id"), batches)
    batch = sum((F.when(F.col("id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines_at, drops_at = new_path(spark, "line-hashes"), new_path(spark, "line-drops")
    hashed = pairs.select("id", "th", batch.alias("batch"), F.posexplode(_hashes(F.col("text"), min_chars)).alias("pos", "h"))
    hashed.where("h IS NOT NULL").select("id", "th", "pos", "h.h1", "h.h2", "batch").write.partitionBy("batch").parquet(lines_at)
    lines = spark.read.schema("id long, th long, pos int, h1 long, h2 long, batch int").parquet(lines_at)
    runs = Runs(spark, fanout, path=path)
    try:
        for k in range(len(bounds) + 1):
            runs.compact()
            held = lines.where(F.col("batch") == k).drop("batch")
            keys = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
            tagged = written(runs.seen(keys), "line-keys")
            runs.add(tagged.where("old IS NULL"))
            shared = tagged.where("old IS NOT NULL OR last > first").select("h1", "h2", F.coalesce("old", "first").alias("first"), "n")
            most = max(100, (tagged.agg(F.sum("n")).first()[0] or 0) * hot_share)
            hot = shared.where(F.col("n") > most).select("h1", "h2", F.col("first").alias("hot_first"))
            cold = shared.where(F.col("n") <= most).select("h1", "h2", "first")
            met = held.join(F.broadcast(hot), ["h1", "h2"], "left")
            gone = met.where("hot_first <> id").select("id", "th", "pos")
            gone = gone.union(met.where("hot_first IS NULL").join(cold, ["h1", "h2"]).where("first <> id").select("id", "th", "pos"))
            # one sorted list a document, bounded by its lines; a document is in one batch
            gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")).write.mode("append").parquet(drops_at)
            release(tagged)
        runs.save()
    finally:
        runs.drop()
    remove(spark, lines_at)
    gone = spark.read.schema("id long, th long, gone array<int>").parquet(drops_at)
    # columns are named through their tables, as docs may have columns of the same names
    own = [docs[f"`{c}`"] for c in docs.columns]
    text, places = F.coalesce(docs["text"], F.lit("")), gone["gone"]
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == gone["id"]) & (F.xxhash64(text) == gone["th"])
    lines = lines_of(text)
    kept = F.when(places.isNull(), text).otherwise(F.array_join(_without(lines, places), "\n"))
    dropped = F.coalesce(F.size(places), F.lit(0))
    return docs.join(gone, on, "left").select(*own, kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def _row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _without(lines: Column, gone: Column) -> Column:
    """lines but those at the sorted positions `gone`, in linear time: a flag for each line, zipped with the lines."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    flags = F.flatten(F.zip_with(before, gone, lambda p, g: F.concat(F.array_repeat(F.lit(True), g - p - 1), F.array(F.lit(False)))))
    flagged = F.zip_with(lines, flags, lambda x, f: F.struct(x.alias("line"), F.coalesce(f, F.lit(True)).alias("stay")))
    return F.transform(F.filter(flagged, lambda x: x["stay"]), lambda x: x["line"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
firsts AS (
  SELECT k, min(doc_id) AS f FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> f.f, false) AS gone FROM lines l LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
