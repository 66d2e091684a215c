"""The trie of words asks only for pieces that may still reach so far."""

import random

from lodestar.llm import sentencepiece_codec as S


class Counted(dict):
    asked = 0

    def get(self, *key):
        Counted.asked += 1
        return super().get(*key)


def test_lookups_of_random_words():
    codec, plain = (S.Codec(open(S.default_model(), "rb").read()) for _ in range(2))
    rng = random.Random(7)
    words = {"▁" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789é✗", k=rng.randint(4, 24))) for _ in range(500)}
    for name in ("number", "starts"):
        if hasattr(codec, name):
            codec.__dict__[name] = Counted(getattr(codec, name))
    codec.learn(words)
    letters = sum(map(len, words))
    assert Counted.asked < 5 * letters  # about 15 a letter when every begin within the longest piece is asked for
    for w in words:
        ids = [i for p in plain.merged(w) for i in ([plain.ids[p]] if p in plain.ids else [plain.bytes[b] for b in p.encode()])]
        assert list(memoryview(codec.known[w]).cast("i")) == ids
