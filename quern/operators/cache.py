"""Result caches (LRU, LFU), and what they would do on a trace of accesses."""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import shared_dir


class LRUCache:
    """Least recently used goes first.  A capacity of 0 counts as 1."""

    def __init__(self, capacity: int):
        self.capacity, self.items = max(1, capacity), OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key):
        if key in self.items:
            self.hits += 1
            self.items.move_to_end(key)
            return self.items[key]
        self.misses += 1
        return None

    def put(self, key, value) -> None:
        if key not in self.items and len(self.items) >= self.capacity:
            self.items.popitem(last=False)
            self.evictions += 1
        self.items[key] = value
        self.items.move_to_end(key)

    def clear(self) -> None:
        self.items.clear()

    @property
    def hit_ratio(self) -> float:
        seen = self.hits + self.misses
        return self.hits / seen if seen else 0.0


class LFUCache(LRUCache):
    """Least frequently used goes first; of equals, the least recently used."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.times: dict = {}
        self.levels: dict[int, OrderedDict] = {}

    def _touch(self, key) -> None:
        n = self.times.get(key, 0)
        if n:
            del self.levels[n][key]
            if not self.levels[n]:
                del self.levels[n]
        self.times[key] = n + 1
        self.levels.setdefault(n + 1, OrderedDict())[key] = None

    def get(self, key):
        if key in self.items:
            self.hits += 1
            self._touch(key)
            return self.items[key]
        self.misses += 1
        return None

    def put(self, key, value) -> None:
        if key not in self.items and len(self.items) >= self.capacity:
            low = min(self.levels)
            gone, _ = self.levels[low].popitem(last=False)
            if not self.levels[low]:
                del self.levels[low]
            del self.items[gone], self.times[gone]
            self.evictions += 1
        self.items[key] = value
        self._touch(key)

    def clear(self) -> None:
        super().clear()
        self.times.clear()
        self.levels.clear()


#: Accesses of a trace above which it is run in parts, and of a part.
PART = 1 << 20

_ROW = "trace string, step long, key string, hit boolean"


def _runs(kind: type[LRUCache], capacity: int, states: dict | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Ordered accesses with their hits. With ``states``, a trace goes on from its pickled cache, and ends with a row of the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace = cache = None

        def end() -> pd.DataFrame:
            return pd.DataFrame({"trace": [trace], "step": [None], "key": [None], "hit": [None], "state": [pickle.dumps(cache)]})

        for df in frames:
            hits, done = [], []
            for t, key in zip(df["trace"], df["key"]):
                if cache is None or t != trace:
                    if cache is not None and states is not None:
                        done.append(end())
                    trace, cache = t, pickle.loads(states[t]) if states and t in states else kind(capacity)
                hit = cache.get(key) is not None
                if not hit:
                    cache.put(key, True)
                hits.append(hit)
            yield df.assign(hit=hits) if states is None else df.assign(hit=hits, state=None)
            yield from done
        if cache is not None and states is not None:
            yield end()

    return run


def simulate(accesses: DataFrame, policy: str, capacity: int) -> DataFrame:
    """(trace, step, key, hit) of accesses (trace, step, key); a miss is followed by a put.

    Rows stream in order through one cache for each trace, so the state is the cache and not the trace. A trace of more
    than ``PART`` accesses is cut by its steps, and its parts are run one after the other, each from the cache of the one before.
    """
    kind = {"lru": LRUCache, "lfu": LFUCache}[policy]
    rows = accesses.select(F.col("trace").cast("string"), F.col("step").cast("long"), F.col("key").cast("string"))
    long = rows.groupBy("trace").agg(F.count("*").alias("n")).where(F.col("n") > PART).collect()  # one row in PART at most
    if not long:
        return rows.repartition("trace").sortWithinPartitions("trace", "step").mapInPandas(_runs(kind, capacity), _ROW)
    spark, n = rows.sparkSession, -(-max(r["n"] for r in long) // PART)
    base = f"{shared_dir(spark)}/quern/trace-{uuid.uuid4().hex}"
    named = F.broadcast(spark.createDataFrame([(r["trace"],) for r in long], "long string"))
    same = F.col("trace").eqNullSafe(F.col("long"))
    those = rows.join(named, same).drop("long")
    cuts = those.groupBy(F.col("trace").alias("long")).agg(F.percentile_approx("step", [k / n for k in range(1, n)], 10_000).alias("cuts"))
    cut = those.join(F.broadcast(cuts), same).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("step"))))
    cut.select("trace", "step", "key", "part").repartition("trace", "part").write.partitionBy("part").parquet(f"{base}/parts")
    states, parts = {}, spark.read.schema("trace string, step long, key string, part int").parquet(f"{base}/parts")
    for k in range(n):
        part = parts.where(F.col("part") == k).drop("part").repartition("trace").sortWithinPartitions("trace", "step")
        part.mapInPandas(_runs(kind, capacity, states), f"{_ROW}, state binary").write.parquet(f"{base}/hits/{k}")
        ends = spark.read.schema(f"{_ROW}, state binary").parquet(f"{base}/hits/{k}").where("state IS NOT NULL")
        states = states | {r["trace"]: bytes(r["state"]) for r in ends.select("trace", "state").collect()}  # one row for each long trace
    done = spark.read.schema(f"{_ROW}, state binary").parquet(*(f"{base}/hits/{k}" for k in range(n))).where("state IS NULL").drop("state")
    rest = rows.join(named, same, "left_anti")
    return done.unionByName(rest.repartition("trace").sortWithinPartitions("trace", "step").mapInPandas(_runs(kind, capacity), _ROW))
