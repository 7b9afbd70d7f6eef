"""Adaptive selection: each select may split the piece of the table that it touched.

A cracked table keeps a driver-side catalogue of boundaries on one column and a piece of data between
neighbouring boundaries.  Selecting x splits the piece around x into what is below, equal and above, and
remembers both boundaries, also where x is absent.  A piece is kept when it is first read, so a later select
within it reads that piece and not the table; a piece that was split goes once both its parts were asked for.
A piece that was split ``DEPTH`` times is checkpointed.  Batches of keys crack once, at quantiles of the keys:
rows are dealt by piece and kept, and a batch reads the pieces that hold its keys.

Policies are representations of one bag and answer alike:

* ``scan``: no catalogue.  ``plain``: splits at every new key.  ``recognitive``: also answers a key
  whose two boundaries are known from its piece without looking further.
* ``compactive``: pieces of equal keys shrink to (key, ofs, len) over the base table.
* ``underswap``, ``overswap``: runs (value, start, len) over the base; overswap cuts long runs.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissure.operators import runs, tables
from fissure.operators.index import CrackerIndex
from fissure.plans.lineage import cut

POLICIES = ("scan", "plain", "recognitive", "compactive", "underswap", "overswap")
DEPTH = 8
LONGEST_RUN = 1 << 16


class CrackedTable:
    def __init__(self, df: DataFrame, on: str, policy: str = "recognitive"):
        if policy not in POLICIES:
            raise ValueError(f"no policy {policy}")
        if on not in df.columns:
            raise ValueError(f"no column {on}")
        self.policy = policy
        self.columns = [c for c in df.columns if c != "pos"]
        self.hits = 0
        self._kept: DataFrame | None = None
        self._rows = df
        self.crack_on(on)

    def crack_on(self, on: str) -> None:
        """Chooses the cracker column; the catalogue starts anew."""
        self.on = on
        self._bounds: list[int] = []
        self._base = self._entries = None
        if self.policy in ("compactive", "underswap", "overswap"):
            order = [on, *(c for c in self.columns if c != on)]
            self._base = cut(tables.with_place(self._rows.select(*self.columns), order))
            if self.policy == "compactive":
                entries = runs.compact(self._base, on).select(F.col("key").alias("value"), F.col("ofs").alias("start"), "len")
            else:
                entries = runs.rle_runs(self._base, on)
                if self.policy == "overswap":
                    entries = runs.split_runs(entries, LONGEST_RUN)
            self._entries = cut(entries)
        self._key = "value" if self._entries is not None else on
        self._kept_pieces: list[DataFrame] = []
        self._parents: dict[int, list] = {}
        self._pieces: list[tuple[DataFrame, int]] = [(self._entries if self._entries is not None else self._rows, 0)]

    def append(self, more: DataFrame) -> None:
        """Rows are visible to selects at once; the catalogue starts anew."""
        self._rows = tables.append(self._rows.select(*self.columns), more)
        self.crack_on(self.on)

    def _split(self, key: int) -> None:
        """Makes ``key`` a boundary: values below it left, others right."""
        if key in self._bounds:
            return
        i = bisect_right(self._bounds, key)
        piece, depth = self._pieces[i]
        if depth >= DEPTH:
            piece, depth = cut(piece), 0
        column = F.col(self._key)
        parts = [self._keep(piece.where(column < key)), self._keep(piece.where(column >= key))]
        for part in parts:
            self._parents[id(part)] = [piece, {id(p) for p in parts}]
        self._pieces[i : i + 1] = [(part, depth + 1) for part in parts]
        self._bounds.insert(i, key)

    def _keep(self, piece: DataFrame) -> DataFrame:
        self._kept_pieces.append(piece.persist(StorageLevel.MEMORY_AND_DISK))
        return piece

    def _asked(self, piece: DataFrame) -> DataFrame:
        """Notes that a piece is read; what it was cut from is no longer needed when its other part was, too."""
        if found := self._parents.pop(id(piece), None):
            parent, waiting = found
            waiting.discard(id(piece))
            if any(p is parent for p in self._kept_pieces) and not any(v[0] is parent for v in self._parents.values()):
                self._kept_pieces = [p for p in self._kept_pieces if p is not parent]
                parent.unpersist()
        return piece

    def _piece(self, x: int) -> DataFrame:
        """The rows equal to x."""
        if self.policy == "scan":
            return self._pieces[0][0].where(F.col(self._key) == x)
        known = x in self._bounds and x + 1 in self._bounds
        if known and self.policy != "plain":
            self.hits += 1
        else:
            self._split(x)
            self._split(x + 1)
        piece = self._asked(self._pieces[bisect_right(self._bounds, x)][0])
        return piece if known and self.policy != "plain" else piece.where(F.col(self._key) == x)

    def _values(self, piece: DataFrame, columns: list[str]) -> DataFrame:
        if self._entries is None:
            return piece.select(*columns)
        return runs.decompress(piece, self._base, columns, "start")

    def select(self, x: int, column: str | None = None) -> DataFrame:
        """All rows, or one column, where the cracker column equals x."""
        return self._values(self._piece(x), [column] if column else self.columns)

    def select_range(self, low: int, high: int, column: str | None = None, low_in: bool = True, high_in: bool = True) -> DataFrame:
        """Rows from low to high; each end is in or out.  Cracks at both ends."""
        first, after = low if low_in else low + 1, high + 1 if high_in else high
        columns = [column] if column else self.columns
        if after <= first:
            return self._values(self._pieces[0][0].where(F.lit(False)), columns)
        if self.policy == "scan":
            key = F.col(self._key)
            return self._values(self._pieces[0][0].where((key >= first) & (key < after)), columns)
        self._split(first)
        self._split(after)
        inside = [self._asked(p) for p, _ in self._pieces[bisect_right(self._bounds, first) : bisect_right(self._bounds, after)]]
        out = inside[0]
        for piece in inside[1:]:
            out = out.unionByName(piece)
        return self._values(out, columns)

    def select_granular(self, x: int, size: int, column: str | None = None) -> DataFrame:
        """Rows whose value lies in the same granule of ``size`` as x."""
        low = (x // size) * size
        return self.select_range(low, low + size - 1, column)

    def select_many(self, keys: DataFrame, column: str) -> DataFrame:
        """(key, column) for a table of keys: one join with the pieces that hold a key; adaptive execution
        broadcasts keys if they are few."""
        wanted = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
        if self._kept is not None and len(self._bounds):
            self.touched = sorted(r[0] for r in wanted.select(self._number(F.col("_key"))).distinct().collect())  # at most one number for each piece
            source = self._kept.where(F.col("_piece").isin(self.touched)).drop("_piece")
        else:
            source = self._entries if self._entries is not None else self._rows
        found = source.join(wanted, source[self._key] == wanted._key)
        if self._entries is None:
            return found.select(F.col("_key").alias("key"), column)
        found = found.select(F.col("value").alias("key"), "start", "len")
        return runs.positions(found, "start").join(self._base.select("pos", column), "pos").select("key", column)

    def crack_at_quantiles(self, keys: DataFrame, pieces: int = 8) -> None:
        """Splits once for a whole batch of keys: rows are dealt by piece and kept, so that a piece is read
        alone and joins find the table laid out."""
        found = keys.approxQuantile(keys.columns[0], [i / pieces for i in range(1, pieces)], 0.01)
        bounds = sorted({*self._bounds, *map(int, found)})
        source = self._entries if self._entries is not None else self._rows
        self.close()
        self._bounds = bounds
        dealt = source.withColumn("_piece", self._number(F.col(self._key))).repartition(len(bounds) + 1, "_piece").sortWithinPartitions("_piece")
        self._kept = dealt.persist(StorageLevel.MEMORY_AND_DISK)
        if self._entries is not None:
            self._entries = self._kept.drop("_piece")
        else:
            self._rows = self._kept.drop("_piece")
        self._pieces = [(self._kept.where(F.col("_piece") == i).drop("_piece"), 0) for i in range(len(bounds) + 1)]

    def _number(self, value: Column) -> Column:
        """The piece that holds a value."""
        return sum(((value >= b).cast("int") for b in self._bounds), F.lit(0)) if self._bounds else F.lit(0)

    def close(self) -> None:
        """Drops the pieces that are kept."""
        for piece in self._kept_pieces:
            piece.unpersist()
        self._kept_pieces, self._parents = [], {}
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def rows(self) -> DataFrame:
        """The whole bag, from its representation."""
        if self._entries is None:
            return self._rows.select(*self.columns)
        return self._values(self._entries, self.columns)

    def catalogue(self) -> CrackerIndex:
        """Boundaries with the number of values below each; one pass."""
        if not self._bounds:
            return CrackerIndex()
        source = self._rows.select(self.on)
        counts = source.agg(*(F.count_if(F.col(self.on) < k) for k in self._bounds)).first()
        return CrackerIndex(dict(zip(self._bounds, counts)))


def crack_three_counts(rows: DataFrame, column: str, keys: list[int]) -> DataFrame:
    """(key, pos_lo, pos_hi): how many values lie below each key, and below or at it."""
    sums = []
    for i, k in enumerate(keys):
        sums += [F.count_if(F.col(column) < k).alias(f"lo{i}"), F.count_if(F.col(column) <= k).alias(f"hi{i}")]
    parts = F.array(
        *(
            F.struct(F.lit(k).cast("bigint").alias("key"), F.col(f"lo{i}").alias("pos_lo"), F.col(f"hi{i}").alias("pos_hi"))
            for i, k in enumerate(keys)
        )
    )
    return rows.agg(*sums).select(F.inline(parts))
