"""Licence notices among ordinary words."""

import math
import re
from collections import Counter

from lineloom.llm import licenses


def test_common_words_weigh_little(spark):
    line = "# Released under the MIT License. The and of thing in re to that was is."
    common = "the and of thing in re to that was is"
    rows = [("a/x.py", line), *((f"b/{i}.py", common + f" word{i}") for i in range(3000))]
    words = [re.findall(licenses._WORD, t.lower()) for _, t in rows]
    df = Counter(w for ws in words for w in set(ws))
    template = re.findall(licenses._WORD, licenses.TEMPLATES["MIT"][0].lower())
    weigh = lambda ws: {w: k * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for w, k in Counter(ws).items()}
    x, y = weigh(words[0]), weigh(template)
    want = sum(v * y.get(w, 0) for w, v in x.items()) / math.hypot(*x.values()) / math.hypot(*y.values())
    got = licenses.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [(r["path"], r["licence"], r["similarity"]) for r in got] == [("a/x.py", "MIT", round(want, 6))]
