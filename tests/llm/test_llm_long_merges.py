import random
import time

import public_tokenizers
import pytest

from clauselake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_merges(model, text):
    parts = list(text)
    while True:
        scored = [(-model.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.score]
        if not scored:
            return parts
        at = min(scored)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def test_merges_equal_the_plain_loop(model):
    rng = random.Random(1)
    for n in [*range(40), 100, 257]:
        for text in (pieces.MARK * n, "".join(rng.choice("theandi" + pieces.MARK) for _ in range(n))):
            assert model.merged(text) == plain_merges(model, text)


def test_a_long_run_of_blanks_takes_no_square_time(model):
    began = time.process_time()
    assert "".join(model.merged(pieces.MARK * 50_000)) == pieces.MARK * 50_000
    assert time.process_time() - began < 20
