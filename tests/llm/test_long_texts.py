"""Memory for one very long text, and dictionaries of which every part is in use."""

import os
import random
import subprocess
import sys

from lodewell.llm import langid

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ONE_WORD = """
import resource
import numpy as np
from lodewell.llm import substring
docs = substring.Passages([b"word " * (4 << 20)])
value = np.unique(docs.runs()[1])
none = np.zeros(1, np.uint64)
gone = substring.covered_words(docs, np.array([0]), np.full(1, substring.ENTRY_WHOLE), value, np.zeros(1, np.int64), none, none)
print(bool(gone.all()), len(value), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_twenty_megabytes_of_one_word_take_less_than_a_gigabyte():
    out = subprocess.run([sys.executable, "-c", ONE_WORD], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": REPO}, check=True)
    whole, values, megabytes = out.stdout.split()
    assert whole == "True" and values == "1" and int(megabytes) < 1024


def words(seed, size):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(20_000)]
    return " ".join(rng.choice(some) for _ in range(size // 6)).encode()


def test_every_part_of_a_dictionary_of_four_megabytes_is_in_use():
    one, two = words(1, 4 << 20), words(2, 4 << 20)
    scorer = langid.LanguageModel((("one", one), ("two", two))).scorer()
    for share in (0, 0.1, 0.25, 0.5, 0.75, 0.99):
        at = int(share * len(one))
        block = one[at : at + 4000]
        assert len(scorer.compressors[0].compress(block)) < len(block) / 10
        assert len(scorer.compressors[1].compress(block)) > len(block) / 4


def test_dictionaries_stay_within_their_bytes(spark):
    rows = [(i, "la mer " * 100, "fr") for i in range(40)] + [(100 + i, "the sea " * 5000, "en") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = dict(langid.fit(df, bytes_per_language=3000).dictionaries)
    assert 2100 <= len(model["fr"]) <= 3010  # whole texts only
    assert len(model["en"]) == 40_000  # none fits: the shortest is the dictionary
