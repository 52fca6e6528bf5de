"""Sequenced change applier: numbered changes of each client applied in order by a stateful stream.

Changes reach the stream in batches. The state of a client is a map from number to held row, the next number and the
values as they stand. Whatever order the rows of a batch arrive in, the first of a number by (day, change_id) is held and
the others are rejected, so a client's rows are neither sorted nor gathered. Each row carries its batch's clock (the
largest day of earlier batches); clock rows carry it to every known client, also to those without a change in the batch,
so that gaps that waited long enough are jumped.

Python pays for each key and each call of the state far more than for a client's work. So small clients share a key: a
team's states are read once and written once a batch, and one clock row reaches all its clients. The number of teams grows
with the table. A client of many numbers is a key of its own and looks its held rows up in the state one by one, so that
no task has them all in memory. All else (numbering, batches, clock rows, results) is spread by (client, number). Nothing
but three numbers a batch and one count a sort partition reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ._common import discard, materialize, ranked, shared_folder

COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
_CHANGE = "n long, change_id long, day long, op string, city string, balance double"
_RESULT = "change_id long, client_id long, n long, status string, batch int, missed long, city string, balance double, op string"
#: Narrow rows with one struct: every cell costs the stream. A clock row has no change and no client.
FED = f"team string, client_id long, clock long, change struct<{_CHANGE}>, batch int"  # the folder's column comes last
RESULTS = [part.split()[0] for part in _RESULT.split(", ")]
MADE = ", ".join(f"{name} array<{kind}>" for name, kind in (part.split() for part in _RESULT.split(", ")))  # many results a row, by column
_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(text: str) -> T.StructType:
    """A schema from its text, also where no session is at hand."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


_HELD = "change_id long, day long, op string, city string, balance double, batch int"
_NOW = "next long, city string, balance double, held long, earliest long, op string"
#: A team's state by column: its clients, then their held rows (``of``: the client's place).
_CLIENTS = "client_id long, next long, city string, balance double, op string"
_ROWS = "of long, n long, change_id long, day long, op string, city string, balance double, batch long"
_TEAM = T.StructType(
    [T.StructField(prefix + f.name, T.ArrayType(f.dataType)) for prefix, text in (("", _CLIENTS), ("held_", _ROWS)) for f in _struct(text)]
)
ALONE = "client "  # the team of a client with more than FEW numbers starts so
FEW, TEAM_ROWS, TEAMS = 1024, 4096, 64  # numbers of a client in a team; rows of a team, about, over all batches; teams at least
FOREVER = 1 << 40  # a clock that every held row's patience has run out by
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


START = (1, None, None, 0, FOREVER, None)


class Applier(StatefulProcessor):
    """State of one client: ``held`` n -> row, ``now`` the next number and the current values."""

    def __init__(self, patience: int, last_batch: int, at_once: int = 4096) -> None:
        self.patience, self.last_batch, self.at_once = patience, last_batch, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", _struct("n long"), _struct(_HELD))
        self.now = handle.getValueState("now", _struct(_NOW))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for result in self.one_client(key[0], rows):
            yield Row(made=dict(zip(RESULTS, result, strict=True)))

    def one_client(self, client_id: int | None, rows: Iterator[Row]) -> Iterator[tuple]:
        before = self.now.get()
        one = Client(client_id, self.held, before or START)
        batch = None
        for r in rows:
            if batch is None:
                batch = r.batch
                if r.clock is not None:
                    yield from one.jump(r.clock - self.patience, batch)
            if r.change is not None:  # else a clock row
                yield from one.take(r.change, batch, self.at_once)
        yield from one.admit(batch)
        if batch == self.last_batch:
            yield from one.last(batch)
        if (after := one.state()) != before:
            self.now.update(after)

    def close(self) -> None:
        pass


class TeamApplier(Applier):
    """State of a key: that of one client as above, or ``team``, that of many small ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.team = handle.getValueState("team", _TEAM)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if key[0].startswith(ALONE):
            name = key[0].removeprefix(ALONE)
            results = self.one_client(None if name == "null" else int(name), rows)
        else:
            results = self.many_clients(rows)
        while some := list(islice(results, self.at_once)):
            yield Row(**dict(zip(RESULTS, zip(*some, strict=True), strict=True)))

    def many_clients(self, rows: Iterator[Row]) -> Iterator[tuple]:
        clients, batch, seen = _unpacked(self.team.get()), None, {}
        for r in rows:
            if batch is None:
                batch = r.batch
                if r.clock is not None:
                    for one in clients.values():
                        yield from one.jump(r.clock - self.patience, batch)
            if r.change is None:  # a clock row
                continue
            if (one := clients.get(r.client_id)) is None:
                one = clients[r.client_id] = Client(r.client_id, Shelf(), START)
            seen[r.client_id] = one
            yield from one.take(r.change, batch, self.at_once)
        for one in seen.values():
            yield from one.admit(batch)
        if batch == self.last_batch:
            yield from chain.from_iterable(one.last(batch) for one in clients.values())
        self.team.update(_packed(clients.values()))


class Shelf(dict):
    """Held rows of a small client, by number, with the calls of a map state."""

    getValue, removeKey, updateValue = dict.get, dict.__delitem__, dict.__setitem__  # noqa: N815

    def iterator(self) -> Iterator[tuple]:
        return iter(self.items())


def _packed(clients: Iterable[Client]) -> tuple:
    """The value of ``_TEAM``."""
    known, held = [], []
    for at, one in enumerate(clients):
        known.append((one.client_id, one.next, one.city, one.balance, one.op))
        held += [(at, n, *row) for (n,), row in one.map.items()]
    return (*map(list, zip(*known, strict=True)), *(map(list, zip(*held, strict=True)) if held else [[] for _ in _ROWS.split(", ")]))


def _unpacked(team: tuple | None) -> dict[int | None, Client]:
    if team is None:
        return {}
    width = len(_CLIENTS.split(", "))
    clients = [Client(c, Shelf(), (n, city, balance, 0, FOREVER, op)) for c, n, city, balance, op in zip(*team[:width], strict=True)]
    for of, n, *row in zip(*team[width:], strict=True):
        one = clients[of]
        one.map[(n,)] = tuple(row)
        one.n_held += 1
        one.earliest = min(one.earliest, row[1])
    return {one.client_id: one for one in clients}


class Client:
    """One client's state while a batch is worked on."""

    def __init__(self, client_id: int | None, held: object, now: tuple) -> None:
        self.client_id, self.map = client_id, held
        self.next, self.city, self.balance, self.n_held, self.earliest, self.op = now
        self.fresh: dict[int, tuple] = {}  # the batch's rows that are neither rejected nor in the map yet

    def state(self) -> tuple:
        return (self.next, self.city, self.balance, self.n_held, self.earliest, self.op)

    def rejected(self, n: int, row: tuple) -> tuple:
        return (row[0], self.client_id, n, "rejected", row[5], 0, None, None, row[2])

    def last(self, batch: int) -> Iterator[tuple]:
        if self.next > 1:  # the number before next is the last that was applied
            yield (None, self.client_id, self.next - 1, "last", batch, 0, None, None, self.op)

    def applied(self, row: tuple, batch: int, missed: int = 0) -> tuple:
        """Apply the row whose number is next."""
        _, _, op, city, balance, _ = row
        if op == "D":
            self.city = self.balance = None
        elif op == "I":
            self.city, self.balance = city, balance
        elif op == "U":
            self.city = self.city if city is None else city
            self.balance = self.balance if balance is None else balance
        self.op, n = op, self.next
        self.next += 1
        return (row[0], self.client_id, n, "applied", batch, missed, self.city, self.balance, op)

    def take(self, change: dict, batch: int, at_once: int) -> Iterator[tuple]:
        """Reject a row of the batch or keep it in ``fresh``; full, that goes into the map."""
        n, *row = change.values()
        row = (*row, batch)
        if n < self.next:
            yield self.rejected(n, row)
            return
        if (other := self.fresh.get(n)) is not None:
            row, other = sorted((row, other), key=_order)
            yield self.rejected(n, other)
        self.fresh[n] = row
        if len(self.fresh) >= at_once:
            yield from self.hold()

    def pop(self, batch: int, missed: int = 0) -> Iterator[tuple]:
        """Apply held rows for as long as numbers follow one another."""
        while self.n_held and (row := self.map.getValue((self.next,))) is not None:
            self.map.removeKey((self.next,))
            self.n_held -= 1
            yield self.applied(row, batch, missed)
            missed = 0

    def jump(self, before: int, batch: int) -> Iterator[tuple]:
        """Apply every held row up to the last one that has waited since ``before`` or longer, over all gaps, and what follows it.

        Each jump goes to the smallest held number, and jumps go on while a held row is that old: so they end past the
        largest number among such rows. ``earliest`` may be too small, never too large; a walk over the map mends it.
        """
        if not self.n_held or self.earliest > before:
            return
        numbers, old, self.earliest = [], 0, FOREVER
        for (n,), row in self.map.iterator():
            numbers.append(n)
            if row[1] <= before:
                old = max(old, n)
            else:
                self.earliest = min(self.earliest, row[1])
        for n in sorted(n for n in numbers if n <= old):
            if n >= self.next:  # else it went with those before
                missed, self.next = n - self.next, n
                yield from self.pop(batch, missed)

    def hold(self) -> Iterator[tuple]:
        """Put fresh rows into the map; one that an earlier row of its number forbids is rejected."""
        fresh, self.fresh = self.fresh, {}
        for n, row in fresh.items():
            other = self.map.getValue((n,)) if self.n_held else None
            if other is not None:
                other = tuple(other)
                if other[5] == row[5] and _order(row) < _order(other):
                    row, other = other, row
                    self.map.updateValue((n,), other)
                    self.earliest = min(self.earliest, other[1])
                yield self.rejected(n, row)
                continue
            self.map.updateValue((n,), row)
            self.n_held += 1
            self.earliest = min(self.earliest, row[1])

    def admit(self, batch: int) -> Iterator[tuple]:
        """Apply what follows the next number, held or new; hold what does not."""
        fresh = self.fresh
        while True:
            other = self.map.getValue((self.next,)) if self.n_held else None
            row = fresh.get(self.next)
            if other is None and row is None:
                break
            if row is not None:
                del fresh[self.next]
            if other is not None:
                other = tuple(other)
                self.map.removeKey((self.next,))
                self.n_held -= 1
                if row is None:
                    row = other
                else:
                    if other[5] != row[5] or _order(other) < _order(row):
                        row, other = other, row
                    yield self.rejected(self.next, other)
            yield self.applied(row, batch)
        yield from self.hold()
        if not self.n_held:
            self.earliest = FOREVER


def _order(row: tuple) -> tuple:
    """By day, then change_id; rows that agree in both go by what they hold, nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in (row[1], row[0], row[2], row[3], row[4]))


def number_changes(changes: DataFrame) -> DataFrame:
    """Distinct changes with n, the dense rank of seq among their client's (nulls first), and ``numbers``, how many ranks that
    client has; without any window by client.

    Distinct (client_id, seq) are sorted over all tasks; a pair's place there minus the first place of its client is its
    rank. A client that holds much of the table is spread like any other. Null clients are one client.
    """
    rows = materialize(changes.select(*COLUMNS).distinct())
    places = ranked(rows.select("client_id", "seq").distinct(), ["client_id", "seq"], "place")
    firsts = places.groupBy(F.col("client_id").alias("c")).agg(F.min("place").alias("first"), F.count("*").alias("numbers"))
    numbers = places.join(firsts, F.col("client_id").eqNullSafe(F.col("c"))).select(
        F.col("client_id").alias("c"), F.col("seq").alias("s"), (F.col("place") - F.col("first") + 1).alias("n"), "numbers"
    )
    both = F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s"))
    out = materialize(rows.join(numbers, both).drop("c", "s"))
    discard(rows)
    discard(places)
    return out


def apply_changes(
    changes: DataFrame, batches: int = 10, origin: int = 19723, span: int = 160, patience: int = 8, drop_mod: int = 11
) -> DataFrame:
    """Apply changes in ``batches`` batches: (change_id, client_id, n, status, batch, missed, city, balance, current).

    ``changes`` has the columns of :data:`COLUMNS`; further ones are not read. n counts a client's distinct seq in order.
    A row's day is the epoch day of valid_at plus up to 15 days of delay, five for each remainder of crc32(change_id) by 4;
    its batch is 1 + floor((day - origin) * batches / span), within 1 and ``batches``. Rows without valid_at, and those
    whose crc32 divides by ``drop_mod`` (as if lost), are numbered but never fed.

    A row whose number is next is applied: I sets city and balance, U those that are not null, D neither (both null);
    any other op changes nothing. Rows of a later number are held; a number below next or held already is rejected. At a
    batch's start a client whose earliest held row is ``patience`` days behind all earlier batches goes on at its
    smallest held number (``missed``: numbers left out). After the last batch all held rows go this way, as one more.

    Nulls: a null client_id is a client, a null seq is its smallest, a null change_id has crc32 0 (of no text) and so is
    never fed. Equal (day, change_id) go by op, city, balance. Repeated rows count once. No rows in, no rows out.
    """
    spark = changes.sparkSession
    numbered = number_changes(changes)
    h = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")), F.lit(0))
    day = (F.unix_date(F.col("valid_at").cast("date")) + 5 * (h % 4)).cast("long")
    number = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - origin) * batches / span)))
    rows = (
        numbered.where("valid_at is not null")
        .where(h % drop_mod != 0)
        .withColumn("day", day)
        .select("change_id", "client_id", "n", "day", "op", "city", "balance", number.cast("int").alias("batch"), "numbers")
    )
    sizes = rows.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("rows")).collect()  # a row a batch
    largest = {r.batch: r.day for r in sizes}
    clocks = {b: max((d for k, d in largest.items() if k < b), default=None) for b in range(1, batches + 1)} | {batches + 1: FOREVER}
    clock = F.lit(None).cast("long")
    for b, at in clocks.items():
        if at is not None:
            clock = F.when(F.col("batch") == b, F.lit(at).cast("long")).otherwise(clock)
    change = F.struct(*(F.col(part.split()[0]) for part in _CHANGE.split(", ")))
    teams = max(TEAMS, sum(r.rows for r in sizes) // TEAM_ROWS)
    name = F.coalesce(F.col("client_id").cast("string"), F.lit("null"))
    team = F.when(F.col("numbers") > FEW, F.concat(F.lit(ALONE), name)).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(teams)).cast("string"))
    rows = rows.withColumn("team", team)
    ticks = (
        rows.groupBy("team").agg(F.min("batch").alias("since"))
        .select("team", F.explode(F.sequence(F.col("since") + 1, F.lit(batches + 1))).alias("batch"))
    )
    fed = rows.select("team", "client_id", "batch", change.alias("change")).unionByName(ticks, allowMissingColumns=True).withColumn("clock", clock)
    folder = f"{shared_folder(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    fed.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/cut")
    discard(numbered)
    made = _streamed(spark, folder, batches, patience)
    lasts = made.where("status = 'last' and op <> 'D' or status = 'last' and op is null").select(F.col("client_id").alias("c"), F.col("n").alias("m"), F.lit(True).alias("is_last"))
    same = F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("status") == "applied")
    return (
        made.where("status <> 'last'")
        .join(lasts, same, "left")
        .select("change_id", "client_id", "n", "status", "batch", "missed", "city", "balance", F.coalesce("is_last", F.lit(False)).alias("current"))
    )


def _streamed(spark: SparkSession, folder: str, batches: int, patience: int) -> DataFrame:
    """Feed cut/batch=k one by one, in order, to a query that starts anew for each, on one checkpoint."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(root)
    fs.mkdirs(hadoop(f"{folder}/fed"))
    stream = (
        spark.readStream.schema(FED).parquet(f"{folder}/fed")
        .groupBy("team")
        .transformWithState(TeamApplier(patience, batches + 1), MADE, outputMode="Append", timeMode="None")
    )
    with _state_settings(spark):
        for k in range(1, batches + 2):
            if not fs.exists(hadoop(f"{folder}/cut/batch={k}")):
                continue
            if not fs.rename(hadoop(f"{folder}/cut/batch={k}"), hadoop(f"{folder}/fed/batch={k}")):
                raise OSError(f"batch {k} could not be moved to {folder}/fed")
            query = (
                stream.writeStream.format("parquet")
                .option("path", f"{folder}/made").option("checkpointLocation", f"{folder}/state")
                .outputMode("append").trigger(availableNow=True).start()
            )
            query.awaitTermination()
    for part in ("cut", "fed", "state"):
        fs.delete(hadoop(f"{folder}/{part}"), True)
    if not fs.exists(hadoop(f"{folder}/made")):
        return spark.createDataFrame([], _RESULT)
    return spark.read.schema(MADE).parquet(f"{folder}/made").select(F.inline(F.arrays_zip(*RESULTS)))


class _state_settings:
    """The state store that transformWithState needs, for as long as the query runs. Each start runs one batch, so stores are closed
    as they commit, take no disk ahead of need, and count no rows (a look-up for each write). The checkpoint lives as long as the
    call, so its files get no second file with a checksum (a fifth of a small store's time)."""

    WANTED = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    }

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = {k: self.conf.get(k, None) for k in self.WANTED}
        for k, v in self.WANTED.items():
            self.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)
