import re

from folioforge.llm import minhash


def test_stated_misses():
    miss = lambda s: (1 - s**minhash.LEFT_ROWS) ** minhash.LEFT + (1 - s**minhash.RIGHT_ROWS) ** minhash.RIGHT
    stated = [float(x) for x in re.findall(r"\de-\d", minhash.__doc__)]
    assert stated == [float(f"{miss(s):.0e}") for s in (0.8, 0.9)]
