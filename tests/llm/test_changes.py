"""The sequenced change applier against a plain loop: its state machine alone, and whole as a stream."""

import datetime
import math
import random
import zlib
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm import changes
from quirespark.llm.changes import COLUMNS, FOREVER, Applier, TeamApplier, apply_changes
from quirespark.llm.changes import _TEAM as TEAM

SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in zip(
            COLUMNS,
            (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.TimestampNTZType(), *[T.StringType()] * 3, T.DoubleType()),
            strict=True,
        )
    ]
)


def plain(fed, batches, patience=8):
    """fed: (batch, day, change_id, client, n, op, city, balance). Rows of the contract's result, cents left as balance."""
    order = lambda x: tuple((v is not None, v) if v is not None else (False,) for v in (x[1], x[2], *x[5:]))
    made, clients, clock = [], {}, None

    def pop(client, s, batch, missed):
        while s["next"] in s["held"]:
            _, change, op, city, balance = s["held"].pop(s["next"])
            s["next"] += 1
            if op == "D":
                s["city"] = s["balance"] = None
            elif op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"] = city if city is not None else s["city"]
                s["balance"] = balance if balance is not None else s["balance"]
            row = [change, client, "applied", batch, missed, s["city"], s["balance"], False]
            s["last"], missed = (row, op), 0
            made.append(row)

    for batch in range(1, batches + 2):
        for client, s in clients.items():
            while s["held"] and (batch > batches or min(h[0] for h in s["held"].values()) + patience <= clock):
                least = min(s["held"])
                missed, s["next"] = least - s["next"], least
                pop(client, s, batch, missed)
        mine = sorted((x for x in fed if x[0] == batch), key=order)
        for _, day, change, client, n, op, city, balance in mine:
            s = clients.setdefault(client, {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if n < s["next"] or n in s["held"]:
                made.append([change, client, "rejected", batch, 0, None, None, False])
            else:
                s["held"][n] = (day, change, op, city, balance)
                pop(client, s, batch, 0)
        clock = max([x[1] for x in mine] + ([] if clock is None else [clock]), default=None)
    for s in clients.values():
        if s["last"] and s["last"][1] != "D":
            s["last"][0][7] = True
    return Counter(map(tuple, made))


class Held(dict):
    getValue, removeKey, updateValue = dict.get, dict.__delitem__, dict.__setitem__  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))


class Now:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def machine(fed, batches, at_once):
    """The processor itself over dictionaries, its rows of a batch in any order."""
    states, made, clock, applier = {}, [], None, Applier(8, batches + 1, at_once)
    for batch in range(1, batches + 2):
        rows = [x for x in fed if x[0] == batch]
        for client in sorted({*states, *(x[3] for x in rows)}):
            mine = [{"n": x[4], "change_id": x[2], "day": x[1], "op": x[5], "city": x[6], "balance": x[7]} for x in rows if x[3] == client]
            mine += [None] * (client in states)
            random.shuffle(mine)
            at = FOREVER if batch > batches else clock
            applier.held, applier.now = states.setdefault(client, (Held(), Now()))
            made += applier.handleInputRows((client,), iter([Row(client_id=client, clock=at, change=c, batch=batch) for c in mine]), None)
        clock = max([x[1] for x in rows] + ([] if clock is None else [clock]), default=None)
    made = [r.made for r in made]
    last = {m["client_id"]: m["n"] for m in made if m["status"] == "last" and m["op"] != "D"}
    return Counter(
        (m["change_id"], m["client_id"], m["status"], m["batch"], m["missed"], m["city"], m["balance"], m["status"] == "applied" and last.get(m["client_id"]) == m["n"])
        for m in made
        if m["status"] != "last"
    )


def test_state_machine_equals_the_plain_loop_in_any_order_of_rows():
    random.seed(7)
    for trial in range(300):
        fed = []
        for change in range(random.randint(0, 40)):
            day = random.randint(0, 60)
            fed.append((1 + day // 16, day, change, random.randint(1, 3), random.randint(1, 15), random.choice("IUUD"), random.choice([None, "a", "b"]), random.choice([None, 1.0, 2.5])))
        assert machine(fed, 4, random.choice([1, 2, 4096])) == plain(fed, 4), trial


def awkward(spark, sf_dir):
    """The smallest table with null ids, a null client with null and repeated numbers, ties, an unknown op, and more columns."""
    at = datetime.datetime(2024, 2, 1)
    rows = [
        (900_001, None, None, "I", at, "s", "g", "x", 1.0), (900_002, None, 5, "U", at, "s", "g", None, 2.0), (900_002, None, 5, "U", at, "s", "g", None, 2.0),
        (900_002, None, 5, "U", at, "s", "g", "tie", 2.0), (None, 1, 1, "I", at, "s", "g", "gone", 3.0), (900_004, 1, 1, "?", at, "s", "g", "x", 3.0),
        (900_005, 900_000, 3, "D", at, None, None, None, None), (900_006, 900_000, 9, "I", None, None, None, "x", None), (900_007, 900_000, -2, None, at, None, None, "x", None),
    ]
    base = spark.read.parquet(f"{sf_dir}/client_changes.parquet").select(*COLUMNS)
    return base.unionByName(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit(7) for c in ("n", "batch", "status", "place", "clock", "Current")})


def prepared(rows):
    rows = {tuple(r[c] for c in COLUMNS): r for r in rows}.values()
    numbers = {}
    for r in rows:
        numbers.setdefault(r.client_id, set()).add(r.seq)
    rank = {c: {s: i for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)), 1)} for c, v in numbers.items()}
    for r in rows:
        h = zlib.crc32(b"" if r.change_id is None else str(r.change_id).encode())
        if r.valid_at is not None and h % 11:
            day = (r.valid_at.date() - datetime.date(1970, 1, 1)).days + 5 * (h % 4)
            yield min(10, 1 + math.floor((day - 19723) * 10 / 160)), day, r.change_id, r.client_id, rank[r.client_id][r.seq], r.op, r.city, r.balance


def test_stream_equals_the_plain_loop(spark):
    changes = awkward(spark, "/root/testdata/sf0.001")
    want = plain(list(prepared(changes.collect())), 10)
    got = apply_changes(changes).select("change_id", "client_id", "status", "batch", "missed", "city", "balance", "current")
    assert Counter(map(tuple, got.collect())) == want
    assert {s for _, _, s, *_ in want} == {"applied", "rejected"} and any(m for *_, m, _, _, _ in want)
    assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit", "false") == "false"  # as before


def test_no_rows(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_key_serves_many_clients(spark, monkeypatch):
    """Before, every known client was a key of its own in each of eleven batches, at the cost of a key: check_l took over 240 seconds."""
    fed = []
    stream = changes._streamed

    def spied(session, folder, *rest):
        cut = session.read.parquet(f"{folder}/cut")
        fed.append(cut.groupBy("batch").agg(F.countDistinct("team").alias("keys"), F.countDistinct("client_id").alias("clients")).collect())
        return stream(session, folder, *rest)

    monkeypatch.setattr(changes, "_streamed", spied)
    monkeypatch.setattr(changes, "TEAMS", 4)
    monkeypatch.setattr(changes, "FEW", 6)  # teams and clients of their own, side by side
    rows = awkward(spark, "/root/testdata/sf0.001")
    got = apply_changes(rows).select("change_id", "client_id", "status", "batch", "missed", "city", "balance", "current")
    held = rows.where("valid_at is not null").groupBy("client_id").agg(F.countDistinct("seq").alias("n")).collect()
    assert any(r.n > 6 for r in held) and any(r.n <= 6 for r in held)
    assert Counter(map(tuple, got.collect())) == plain(list(prepared(rows.collect())), 10)
    alone = sum(r.n > 6 for r in held)
    assert all(r["keys"] <= 5 + alone for r in fed[0]) and max(r["clients"] for r in fed[0]) > 5 + alone


def test_a_team_equals_its_clients_and_keeps_its_state_by_column():
    random.seed(11)
    for trial in range(100):
        rows = []
        for change in range(random.randint(0, 60)):
            day = random.randint(0, 60)
            rows.append((1 + day // 16, day, change, random.choice([None, 1, 2, 3]), random.randint(1, 15), random.choice(["I", "U", "D", None]), random.choice([None, "a", "b"]), random.choice([None, 1.0, math.inf])))
        team, made, clock = TeamApplier(8, 5), [], None
        team.team = Now()
        for batch in range(1, 6):
            mine = [x for x in rows if x[0] == batch]
            cells = [{"n": x[4], "change_id": x[2], "day": x[1], "op": x[5], "city": x[6], "balance": x[7]} for x in mine]
            at = FOREVER if batch > 4 else clock
            sent = [Row(team="0", client_id=x[3], clock=at, change=c, batch=batch) for x, c in zip(mine, cells, strict=True)]
            if clock is not None:  # known: one clock row for all its clients
                sent.append(Row(team="0", client_id=None, clock=at, change=None, batch=batch))
            random.shuffle(sent)
            for r in team.handleInputRows(("0",), iter(sent), None) if sent else ():
                made += zip(*r, strict=True)
            if team.team.value is not None:
                assert len(team.team.value) == len(TEAM.fields)
            clock = max([x[1] for x in mine] + ([] if clock is None else [clock]), default=None)
        last = {m[1]: m[2] for m in made if m[3] == "last" and m[8] != "D"}
        got = Counter((m[0], m[1], *m[3:8], m[3] == "applied" and last.get(m[1]) == m[2]) for m in made if m[3] != "last")
        assert got == plain(rows, 4), trial
