"""Turn repair against exhaustive edits, a row-by-row brute force and its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from foldwise.llm import turn_repair as R

WHITE = " \t\n\x0b\f\r"


def row_by_row(codes):
    """Least (cost, audit): one pass along the rows over the marks."""
    insert = {(0, 2): (2, "I"), (0, 3): (4, "II"), (1, 2): (2, "I"), (1, 3): (4, "II"), (2, 3): (2, "I"), (3, 2): (2, "I")}

    def close(v):
        out = dict(v)
        for (p, q), (c, a) in insert.items():
            if p in v:
                got = (v[p][0] + c, v[p][1] + a)
                out[q] = min(out.get(q, got), got)
        return out

    state = close({0: (0, "")})
    for code in codes:
        new = {}

        def put(q, value):
            new[q] = min(new.get(q, value), value)

        for p, (c, a) in state.items():
            put(p, (c + 3, a + "D"))
            if code != "x":
                t = int(code.isupper())
                for who in "sua":
                    q = {"0s": 1, "0u": 2, "1u": 2, "2a": 3, "3u": 2}.get(f"{p}{who}")
                    if q is not None:
                        if who == code.lower():
                            put(q, (c + t, a + "K"))
                        if who != "s":
                            put(q, (c + 2 + t, a + "R"))
        state = close(new)
    return min(state[p] for p in (0, 3) if p in state)


def exhaustive(codes, most_inserts):
    """Least (cost, audit) over all edit sequences with at most so many insertions."""
    best = None
    choices = [["D"] if c == "x" else ["D", "K", "Ru", "Ra"] for c in codes]
    gaps = len(codes) + 1
    for edits in itertools.product(*choices):
        for n in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(gaps), n):
                for who in itertools.product("ua", repeat=n):
                    roles, audit, cost = "", "", 0
                    for g in range(gaps):
                        for p, w in zip(places, who):
                            if p == g:
                                roles, audit, cost = roles + w, audit + "I", cost + 2
                        if g < len(codes):
                            e = edits[g]
                            audit += e[0]
                            cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and codes[g].isupper())
                            roles += "" if e == "D" else codes[g].lower() if e == "K" else e[1]
                    if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def all_splits(codes):
    """The full chart: every span, every split."""
    n, chart = len(codes), {}
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            if length == 1:
                chart[i, i + 1] = R.row_cell(codes[i])
                continue
            cells = [R.combine(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert all(c == cells[0] for c in cells)
            chart[i, i + length] = cells[0]
    return R.answer(chart[0, n]) if n else R.answer(R.inserted())


@pytest.mark.parametrize("codes", ["", "s", "u", "a", "x", "o", "su", "us", "aa", "uA", "xSu", "soa", "OUx"])
def test_exhaustive_edits(codes):
    assert R.answer(R.parse(codes)) == row_by_row(codes) == exhaustive(codes, 3) == all_splits(codes)


def test_random_conversations():
    rng = random.Random(3)
    for _ in range(1500):
        codes = "".join(rng.choice("xsuaoSUAO" if rng.random() < 0.6 else "ua") for _ in range(rng.randint(0, 40)))
        assert R.answer(R.parse(codes)) == row_by_row(codes)
    for _ in range(40):
        codes = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 12)))
        assert all_splits(codes) == row_by_row(codes)
    assert R.answer(R.power("x", 1001)) == row_by_row("x" * 1001)


def brute(rows, damage=True):
    """Expected rows by conversation id; ``rows``: (conv_id, turn, role, text)."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        by[c] += [] if hit == 0 else [(t, role, text)] * (2 if hit == 3 else 1)
    out = {}
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, codes, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rs:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = row_by_row(codes)
        said, at, odd = [], 0, (len(audit) - audit.count("D")) % 2
        for e in audit:
            who = "user" if (len(said) - odd) % 2 == 0 else "assistant"
            if e == "I":
                said.append(f"{who}:")
                continue
            _, role, text = rs[at]
            at += 1
            if e != "D":
                said.append(f"{role if e == 'K' else who}:{text}")
        turns = {r[0] for r in rs} - {None}
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EDGE = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 1, None, "x"), (None, None, "user", "a."), (None, 3, "user", "a."), (2, None, None, None),
    (3, 5, "system", "s."), (3, 6, "tool", "t"), (3, 6, "tool", "t"), (3, 9, "", ""), (4, 0, "user", "long " * 50_000), (4, 1, "assistant", "é?\x0b"),
    (5, 2, "user", "same."), (5, 7, "user", "same."), (5, 7, "user", "same."), (6, -4, "assistant", "!"), (6, 2, "user", "　"),
]


def result(spark, rows, damage=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = R.damaged(df) if damage else df.selectExpr("*", "true AS here")
    found = R.verdicts(df, present="here").cache()
    got = found.join(R.digests(df, found, present="here"), "_fw_key").collect()
    assert len(got) == len({r["_fw_key"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in COLS) for r in got}


def test_edge_rows(spark):
    assert result(spark, EDGE) == brute(EDGE)
    assert result(spark, EDGE, False) == brute(EDGE, False)
    assert result(spark, []) == {}


def test_hot_conversation_in_many_spans(spark):
    """One conversation with most of the rows is cut into spans over many tasks; answers do not depend on the cuts."""
    rng = random.Random(8)
    rows = [(7, k // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"Word {k}.", f"cut {k}"])) for k in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(20, 60) for t in range(4)]
    rows += [(8, 1, "user", "again.")] * 200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_repaired_rows_and_clashing_columns(spark):
    rows = [(1, 0, "assistant", "b."), (1, 1, "assistant", "c."), (2, 0, "system", "s."), (3, 0, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS k", "2 AS tk", "3 AS n", "4 AS blank", "5 AS here", "6 AS kind", "7 AS audit", "8 AS c", "9 AS seg", "10 AS cell", "11 AS _fw_key", "12 AS position"
    )
    got = R.repair(df).orderBy("conv_id", "position").collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    for said in by.values():
        assert [s[0] for s in said] == list(range(len(said)))
        assert re.fullmatch("(s?(ua)+)?", "".join(s[1][0] for s in said))
    assert by[3] == [(0, "user", "q."), (1, "assistant", "")]


def test_query_against_brute_force(spark):
    from foldwise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_turn_repair"](spark, sf).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLS) for r in got} == brute(rows) and len(got) == len(brute(rows))
