import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import MEDIUM, as_dicts

from hearthline.llm import dialogue, entry

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """The contract's damage: conversation to its rows (turn, role, text)."""
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        out[conv_id] += []
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv_id] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """Least (cost, audit) over all edits, by plain recursion from the end, with the repaired turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:1].encode(), digest(*r[1:])))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    inf = (10**9, "", ())
    follows = lambda state: "u" if state in ("", "s", "a") else "a"
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {s: (0, "", ()) if s in ("", "a") else inf for s in ("", "s", "u", "a")}

    def inserts(best):
        for _ in range(3):
            best = {s: min(v, (3 + best[follows(s)][0], "I" + best[follows(s)][1], ((("user" if follows(s) == "u" else "assistant"), ""), *best[follows(s)][2]))) for s, v in best.items()}
        return best

    best = inserts(best)
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        late, new = 3 if fault == "truncated" else 0, {}
        for s in best:
            options = [(4 + best[s][0], "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                x = best[follows(s)]
                options.append((3 + late + x[0], "R" + x[1], (("user" if follows(s) == "u" else "assistant", text), *x[2])))
                if (s, role[:1]) in legal:
                    x = best[role[:1]]
                    options.append((late + x[0], "K" + x[1], ((role, text), *x[2])))
            new[s] = min(options)
        best = inserts(new)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, repaired = best[""]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    )


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in as_dicts(dialogue.audit(dialogue.damage(df)))), key=str)
    assert got == sorted(((c, *brute(r)) for c, r in damaged(rows).items()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in as_dicts(entry.op13_conversation_repair(spark, MEDIUM)))
    assert got == sorted((c, *brute(r)) for c, r in damaged(rows).items())


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "And so", "", " \t", None, "Why?", "Ends.\n", "Ünd so weiter", "x" * 50]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    return rows + rows[:40]


def test_messy_rows(spark, messy):
    check(spark, messy)


def test_conversations_longer_than_a_block(spark, messy, monkeypatch):
    """Long conversations are cut into blocks and spread over tasks: the chained blocks equal one piece."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", f"No {t}!", f"so {t}"])) for c in (1, None) for t in range(rng.randint(60, 90)) for _ in range(2)]
    monkeypatch.setattr(dialogue, "BLOCK_ROWS", 7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows + messy[:100])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_crossings_compose():
    rng = random.Random(5)
    for _ in range(50):
        turns = [(rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(12)]
        k = rng.randint(1, 11)
        head, tail = dialogue.crossing(turns[:k]), dialogue.crossing(turns[k:])
        whole = dialogue.crossing(turns)
        for s in range(4):
            for t in range(4):
                assert min(whole[4 * s + t], 10**9) == min(10**9, *(head[4 * s + m] + tail[4 * m + t] for m in range(4)))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " ")]
    turns = as_dicts(dialogue.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "position"))
    assert [(r["conv_id"], r["position"], r["edit"], r["role"], r["text"], r["turn"]) for r in turns] == [
        (1, 0, "K", "user", "Hi.", 0), (1, 1, "I", "assistant", "", None), (1, 2, "K", "user", "Hi there.", 1), (1, 3, "K", "assistant", "Yes.", 2),
    ]


def test_empty_table_clashes_and_long_text(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.audit(dialogue.damage(empty)).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{'word ' * 100_000}{t}.", 1, "x", 2) for t in range(4)]
    got = as_dicts(dialogue.audit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, edits string, digest int")))
    assert [(r["cost"], r["audit"]) for r in got] == [(0, "KKKK")]
