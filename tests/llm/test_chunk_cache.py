from caseloom.llm import chunk_ids


def test_runs_seen_again_are_not_encoded_again():
    """The cache holds 250,000 distinct runs in one generation."""
    cache = chunk_ids.ChunkIds.__new__(chunk_ids.ChunkIds)
    cache.special, cache.lowers, cache.young, cache.old, cache.bytes = [], True, {}, {}, 0
    asked = []
    cache._encoded = lambda runs: asked.append(len(runs)) or [b"1234"] * len(runs)
    texts = [b" ".join(b"w%d" % i for i in range(at, at + 25_000)) for at in range(0, 250_000, 25_000)]
    for text in texts * 2:
        assert cache.of([text]) == [b"1234" * 25_000]
    assert sum(asked) == 250_000
