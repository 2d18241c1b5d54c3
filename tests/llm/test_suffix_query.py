"""The suffix query on passages of over 50 words that repeat across documents, around the 400 bytes of the contract."""

import collections
import hashlib
import random

import numpy as np

from foldwise.llm.queries import QUERIES

LENGTH = 400


def passage(rng, n_words, n_bytes):
    """``n_words`` words that fill ``n_bytes`` bytes with one space between two."""
    sizes = [1] * n_words
    for _ in range(n_bytes - (2 * n_words - 1)):
        sizes[rng.randrange(n_words)] += 1
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(s)) for s in sizes)


def digest(texts):
    """All columns of the query but the id, from every window of every document."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + LENGTH] for b in data for i in range(len(b) - LENGTH + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_passages_around_the_length(spark, tmp_path):
    rng = random.Random(7)
    own = lambda k: chr(ord("A") + k) + passage(rng, 120, 700) + chr(ord("A") + k)
    short, exact, long = passage(rng, 60, 399), passage(rng, 60, 400), passage(rng, 200, 1300)
    accents = passage(rng, 60, 380) + "éö" * 15
    texts = [own(k) for k in range(4)]
    for k, p in enumerate((short, short, exact, exact, long, long, accents, accents), 4):
        texts.append(own(k) + p + own(k))
    texts += [own(12) + long + own(12) + exact + own(12), None, "", passage(rng, 60, 399)]
    rows = [*zip(range(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(texts))] == digest(texts)
    # the size is that of the whole text whether or not bytes go; removals are told by the other columns
    assert [got[k][0] for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[k][1] for k in range(13)] == [0] * 6 + [400] * 2 + [1300] * 2 + [440] * 2 + [1700]
    assert [got[k][2] for k in range(13)] == [0] * 6 + [1] * 6 + [2]
