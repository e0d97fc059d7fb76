"""Conversation repair against plain versions."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wattframe.llm import conversations as c
from wattframe.llm.queries import ORACLES, QUERIES

SCHEMA = (
    "conv_id long, turn long, role string, text string, conv string, copies string, digest string, first string, "
    "f string, some string, audit string, cost string"
)
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows():
    r = random.Random(9)
    texts = ["Hello.", "Who?", "cut off", "", " \t\n", "Yes!", "é", "日本。", "a. ", "x" * 3000 + ".", None, " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "über"]
    found = []
    for conv in range(160):
        for turn in range(r.randint(1, 9)):
            proper = ("user", "assistant")[turn % 2]
            found.append((conv, turn if r.random() < 0.9 else r.randint(0, 5), proper if r.random() < 0.6 else r.choice(roles), r.choice(texts)))
    found += [(200, None, "user", "No turn."), (200, None, "assistant", "No turn."), (201, 5, "user", "a."), (201, 900, "assistant", "b.")]
    found += [(None, t, r.choice(roles), r.choice(texts)) for t in (0, 1, 2, None)]
    found += [(202, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]  # more than a piece
    found += [(203, 1, "user", "same.")] * 600  # one row again and again
    found += found[:30]
    return [(*f, *"abcdefgh") for f in found]


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        sql = f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op13_conversation_repair']})"
        want = Counter(connection.execute(sql).fetchall())
    got = Counter(map(tuple, QUERIES["op13_conversation_repair"](spark, str(tmp_path)).select(*NAMES).collect()))
    assert got == want and got.total() == 165
    assert {x for r in got for x in r[7]} == set("DKR")  # deleting is always cheaper than inserting


def turns(random_, n):
    return [
        c.Turn(b"", b"", random_.choice("suaux"), random_.random() < 0.25, random_.random() < 0.3) for _ in range(n)
    ]


def plain_cheapest(own, start, ends):
    """Least labels of every node, improved until nothing changes."""
    best = {(0, start): (0, "")}
    changed = True
    while changed:
        changed = False
        for (row, place), (cost, audit) in list(best.items()):
            for step, letter, r, p in c.edges(own, row, place):
                label = (cost + step, audit + letter)
                if (r, p) not in best or label < best[r, p]:
                    best[r, p], changed = label, True
    return min((best[len(own), e] for e in ends if (len(own), e) in best), default=None)


def test_search_from_both_sides_finds_the_least_audit():
    r = random.Random(1)
    for _ in range(1500):
        own, start = turns(r, r.randint(0, 12)), r.choice(list(c.STEP))
        for ends in (c.ENDS, (r.choice(list(c.STEP)),)):
            assert c.cheapest(own, start, ends) == plain_cheapest(own, start, ends)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_pieces_make_no_difference(monkeypatch, size):
    r = random.Random(size)
    texts = [b"a.", b"b", b"", b"c?", b"d!"]
    monkeypatch.setattr(c, "PIECE_ROWS", size)
    for _ in range(150):
        talk = c._Conversation(1)
        own = []
        for t in range(r.randint(0, 14)):
            role, text, first = r.choice([b"user", b"assistant", b"system", b"x"]), r.choice(texts), r.random() < 0.8
            talk.add(t, role, text, first, 1)
            core = text.rstrip(c.SPACE)
            own.append(c.Turn(role, text, role[:1].decode(), not core or not first, core[-1:] not in (b".", b"!", b"?")))
        cost, audit = plain_cheapest(own, 0, c.ENDS)
        left = b"\n".join(c.repaired(own, 0, audit))
        assert talk.result()[6:] == (cost, audit, c.hashlib.sha256(left).hexdigest())


def test_repaired_roles_fit_the_pattern():
    r = random.Random(4)
    for _ in range(300):
        own = [t._replace(role=t.initial.encode()) for t in turns(r, r.randint(0, 10))]
        _, audit = c.cheapest(own, 0, c.ENDS)
        roles = b"".join(x.split(b":")[0][:1] for x in c.repaired(own, 0, audit)).decode()
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_nothing_and_undamaged_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair_structure(empty).collect() == []
    own = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    (r,) = c.repair_structure(own).collect()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "KK", 0, 0)
    assert r.repaired_sha256 == c.hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    (none,) = c.repair_structure(own, copies=F.lit(0)).collect()
    assert (none.cost, none.audit, none.repaired_sha256) == (0, "", c.hashlib.sha256(b"").hexdigest())
