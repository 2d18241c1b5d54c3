"""Operators against plain computations on small inputs."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from foldwise.llm import decontaminate, graph, html_crf, mixing, pii, preference, quality_rules, simhash, slots, suffix_dedup, suffix_levels, warc
from foldwise.llm.checks import quality_sql


def words(rng, n):
    return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- suffix arrays


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("many", [5, 2000])
def test_removed_bytes(spark, many):
    rng = random.Random(many)
    passage = words(rng, 400)
    texts = [words(rng, rng.randint(0, 200)) + (passage[: rng.choice([700, 650])] if k % 2 else "") + words(rng, rng.randint(0, 200)) for k in range(60)]
    texts += [texts[1], texts[1], None, "", "ab" * 400, "é" * 300]
    got = {r.doc_id: (sum(s.b - s.a for s in r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, texts), many=many).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts, 400)


def test_family_finds_all_repeats():
    rng, length = random.Random(2), 20
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))).encode() for _ in range(120)]
    family, at, start, found = suffix_levels.Family(length), 0, [], set()
    for k in range(0, len(pieces), 10):
        batch = []
        for p in pieces[k : k + 10]:
            start.append(at)
            batch.append((p, len(p) - length + 1, at, 1))
            at += len(p) - length + 1
        found |= set(family.add(batch).tolist())
    seen = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    want = {s + i for p, s in zip(pieces, start, strict=True) for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1}
    assert found == want and len(family.levels) <= 6


# ---- SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def smallest_linked(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [2, 64])
def test_links_join_what_all_pairs_would(spark, few):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({simhash._signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))) for b in base for _ in range(40)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df, few=few)).collect()}
    want = smallest_linked(values, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert {v: got.get(v, v) for v in values} == want


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [t + " Zz" for t in texts[:10]] + ["A b", "a  b", None, ""]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    f = [fingerprint(t) for t in texts]
    want = smallest_linked(range(len(texts)), lambda a, b: bin(f[a] ^ f[b]).count("1") <= 2)
    assert got == {k: (f[k], want[k]) for k in range(len(texts))}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    own = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)) for _ in range(30)]
    near = [re.sub(r"^\w+ \w+", "other words", t) for t in own[:10]]
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, own + near + own[:3])).collect()}
    assert kept == set(range(30))


# ---- decontamination


def least_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_myers_equals_the_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in "12")
        assert decontaminate.myers(decontaminate.alphabet(a), len(a), b)[0] == min(len(a), least_distance(a, b))


def test_searcher_finds_every_passage_within_budget():
    rng = random.Random(8)
    items = [(k, words(rng, 30)) for k in range(8)]
    search = decontaminate.Searcher(items, 0.08)
    for _ in range(40):
        k, item = rng.choice(items)
        text = list(words(rng, 20) + " " + item + " " + words(rng, 20))
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(len(text))] = rng.choice("abcdexyz")
        t = decontaminate.normal("".join(text))
        want = {i: d for i, x in items if (d := least_distance(decontaminate.normal(x), t)) <= decontaminate.budget(decontaminate.normal(x), 0.08)}
        assert {i: d for i, d, _ in search.scan("".join(text))} == want


# ---- preference model, sharding, rules


def test_preferences_order_held_out_rows():
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, len(preference.NAMES)))
    x[:, 2] += 3 * y
    m = preference.fit_arrays(x[:200], y[:200])
    s = ((x[200:] - m.mean) / m.scale) @ np.array(m.weights)
    assert ((s >= m.threshold) == (y[200:] == 1)).mean() > 0.85


def test_shards_are_balanced_and_edits_move_little(spark, tmp_path):
    rng = random.Random(10)
    df = frame(spark, [words(rng, rng.randint(0, 80)) for _ in range(3000)]).select("doc_id", slots.record_size().alias("size"), slots.virtual_slot(slots=512).alias("v"))
    stats = slots.slot_stats(df, "v", "size")
    one = slots.first_map(stats, 8, 512)
    slots.save_map(one, str(tmp_path / "m"))
    two = slots.rebalance(slots.load_map(spark, str(tmp_path / "m")), stats, 9)
    slots.save_map(two, str(tmp_path / "m"))
    old, new = ({r.v_slot: r for r in slots.load_map(spark, str(tmp_path / "m"), v).collect()} for v in (1, 2))

    def loads(m):
        c = collections.Counter()
        for r in m.values():
            c[r.shard] += r.bytes
        return c

    assert max(loads(old).values()) < 1.01 * min(loads(old).values()) and len(loads(new)) == 9
    assert max(loads(new).values()) < 1.1 * min(loads(new).values())
    assert sum(old[s].shard != new[s].shard for s in old) < 512 / 6


def test_rules_equal_their_sql(spark):
    rng = random.Random(11)
    loop = words(rng, 9)
    texts = [None, "", "a\n\na\nb", " ".join([loop] * 4), words(rng, 40) + "\n" + loop + "\n" + words(rng, 5) + "\n" + loop, "the %%% of ### and" * 12, "THE!! " * 30]
    texts += ["the " + words(rng, rng.randint(5, 80)) for _ in range(40)]
    got = sorted(
        (r.doc_id, *[r.q.measures[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r.q.kept)
        for r in quality_rules.judge(frame(spark, texts), into="q").collect()
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    want = con.execute(f"WITH {quality_sql('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, passes FROM judged ORDER BY 1").fetchall()
    assert got == want


# ---- mixing


def level_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
        free -= over
    return target


def test_mixture_meets_its_targets(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(700)] + [(900, "x y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_copies(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = level_targets(sizes)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r["_fw_copies"] * r["_fw_size"]
        target[r.source] = r["_fw_target"]
        assert 0 <= r["_fw_copies"] <= 3 and r["_fw_source_size"] == sizes[r.source]
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6 and abs(taken[s] - want[s]) <= 0.02 * want[s] + 3
    again = mixing.with_copies(df.repartition(5)).collect()
    assert sorted((r.doc_id, r["_fw_copies"]) for r in got) == sorted((r.doc_id, r["_fw_copies"]) for r in again)


# ---- HTML, personal data, archives


def test_extractor_on_unseen_layouts():
    chain = html_crf.fit(400)
    wrong = total = 0
    for blocks, truth in html_crf.labelled_blocks(150, 50_000):
        got = chain.label(html_crf.block_features(blocks))
        wrong += sum(a != b for a, b in zip(got, truth, strict=True))
        total += len(truth)
    assert total > 1500 and wrong / total < 0.03


def test_viterbi_is_the_best_of_all_labellings():
    chain = html_crf.Chain({"a": 1.0, "b": -0.7, "c": 0.2}, [[0.3, -0.5], [-0.2, 0.6]])
    rng = random.Random(13)
    for _ in range(50):
        f = [(rng.choice("abc"),) for _ in range(rng.randint(1, 7))]

        def value(y, f=f):
            return sum(chain.weights[x[0]] * k for x, k in zip(f, y, strict=True)) + sum(chain.step[p][q] for p, q in zip(y, y[1:], strict=False))

        every = [[n >> k & 1 for k in range(len(f))] for n in range(2 ** len(f))]
        assert abs(value(chain.label(f)) - max(map(value, every))) < 1e-12


KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]

    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(KIND.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a", "b.", "@", "1", "23", "255", ".", "-", " ", "+", "_", "é", "4111111111111111", "a@b.c", "(", ")"]) for _ in range(40)) for _ in range(400)]
    texts += [None, "", "a@b.c_d@e.f", "9" * 20000, "a" * 30000 + "@"]
    trees = pii.fit(spark, 60)
    got = {r.doc_id: r.s for r in pii.detect(frame(spark, texts), trees).select("doc_id", pii.span_list(pii.F.col("pii.base")).alias("s")).collect()}
    assert [got[k] for k in range(len(texts))] == [spans(t) for t in texts]


def test_further_kinds_on_held_out_sentences(spark):
    trees = pii.fit(spark)
    rows = pii.labelled(40, seed=99)
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, text string, kind int, y int")
    hit = {r.n for r in pii.detect(df, trees).filter("exists(pii.more, s -> s.k = kind)").select("n").collect()}
    right = sum((n in hit) == bool(y) for n, (_, _, y) in enumerate(rows))
    assert right / len(rows) > 0.85


def test_loser_tree_merges():
    rng = random.Random(15)
    for k in (0, 1, 2, 3, 7, 12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.merge_runs(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(16)
    html = [words(rng, rng.randint(0, 60)) for _ in range(120)]
    rows = [(k, f"http://h{k % 7}.org/p{k % 5}", rng.choice(html)) for k in range(300)]
    folder, index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect())
    first: dict = {}
    want = []
    for k, _, h in rows:
        b = h.encode()
        seen = first.setdefault(b, k) if len(b) >= 100 else k
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "response" if seen == k else "revisit", None if seen == k else seen))
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_pipeline_runs_to_the_end(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    long = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    good = ["the " + " of ".join(" ".join(rng.sample(long, 12)) for _ in range(6)) for _ in range(60)]
    bench = " ".join(rng.sample(long, 40))
    texts = good + [good[0], good[1] + " end", "bad ### ### " * 30, "the of and " + good[2] + " " + bench, None, ""]
    d = spark.createDataFrame([(k, t, "en", f"s{k % 3}", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    found = {r.doc_id for r in out.collect()}
    assert out.columns == [*d.columns, "shard", "v_slot", "map_version"] and found <= set(range(60)) and len(found) > 15
    kept = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(60))
