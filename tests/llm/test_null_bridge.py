"""A row with a null id links like any other, and may be what joins two others."""

import random

from test_pairs import documents

from millrace.llm.simhash import LOWER, fingerprint, simhash_components


def test_a_null_id_bridges(spark):
    rng = random.Random(31)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    prints = {}
    for _ in range(400):
        copy = list(words)
        copy[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        prints[" ".join(copy)] = fingerprint(" ".join(copy).encode().translate(LOWER).split(), 3)
    middle = fingerprint(" ".join(words).encode().split(), 3)
    near = [(t, p) for t, p in prints.items() if 0 < (p ^ middle).bit_count() <= 3]
    a, c = next((t, u) for t, p in near for u, q in near if (p ^ q).bit_count() > 3)
    alone = simhash_components(documents(spark, [(5, a), (9, c)])).collect()
    assert {r["component_id"] for r in alone} == {5, 9}
    rows = simhash_components(documents(spark, [(5, a), (9, c), (None, " ".join(words))])).collect()
    assert {r["component_id"] for r in rows} == {5} and [r["doc_id"] for r in rows if r["kept"]] == [5]
