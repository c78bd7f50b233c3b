import hashlib
from collections import defaultdict

import numpy as np
from helpers import BLANK, awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import exact_dedup as X


def brute(rows):
    norm = [BLANK.sub(" ", r[1] or "") for r in rows]
    ids = defaultdict(list)
    for r, n in zip(rows, norm, strict=True):
        ids[n].append(r[0])
    out = []
    for r, n in zip(rows, norm, strict=True):
        known = [i for i in ids[n] if i is not None]
        keep = min(known) if known else None
        out.append((r[0], keep, len(ids[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = awkward_rows()
    for kw in ({}, {"primes": (7, 3), "bases": (3, 2)}):  # small primes: nearly every fingerprint clashes
        got = sorted((tuple(r) for r in X.exact_groups(awkward(spark), **kw).collect()), key=str)
        assert got == brute(rows)
    kept = X.drop_exact_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    texts = [BLANK.sub(" ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({x[4] for x in brute(rows)})


def test_empty_table(spark):
    assert X.exact_groups(empty(spark)).count() == 0
    assert X.drop_exact_duplicates(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40), st.integers(0, 300))
def test_fingerprints_compose(data, chunk, cut):
    """Any chunking gives the polynomial itself, and hashes of two parts combine to that of the whole."""
    for prime, base in zip(X.PRIMES, X.BASES, strict=True):
        want = 0
        for b in data:
            want = (want * base + b + 1) % prime
        whole = np.frombuffer(data, np.uint8)
        powers = [X._powers(prime, base, chunk)]
        assert X.fingerprint(whole, powers, (prime,), (base,)) == [want]
        a, b = data[:cut], data[cut:]
        parts = [(X.fingerprint(np.frombuffer(p, np.uint8), powers, (prime,), (base,))[0], len(p)) for p in (a, b)]
        assert X.combine(*parts, prime, base) == (want, len(data))
