"""Operator 4: escapes within escapes are read alike in texts of any length, and as whole layers would be."""

import base64
import random
import time

from trackloom.llm import secrets
from trackloom.llm.secrets import find_secrets

SECRET = "AKIA" + "Q7" * 8


def test_deep_layers_of_long_texts():
    """What only the layer right above the last one shows as a whole: UTF-16 in a run of percent-escapes."""
    hidden = "".join("%" + "25" * 45 + f"{b:02x}" for b in SECRET.encode("utf-16-le"))
    for filler in ("filler, ", "filler, " * 250_000):
        text = f"{filler}<{hidden}> end"
        assert [s for s in find_secrets(text)[1] if s[2] == "access"] == [(len(filler) + 1, len(filler) + 1 + len(hidden), "access")]


def _layered(text):
    """Spans from whole layers, one after the other."""
    found, seen, work = set(), set(), [secrets.Layer(text)]
    while work:
        layer = work.pop()
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        found.update((*layer.where(a, b), kind) for a, b, kind in secrets.scan(layer.text))
        work += secrets._base64_layers(layer)
        made = []
        for m in secrets._ESCAPE.finditer(layer.text):
            if opened := secrets._opened_escape(m.group()):
                made.append((*m.span(), opened[0], [(m.start() + x, m.start() + y) for x, y in opened[1]]))
        if made:
            work += [*secrets._raw_layers(layer), secrets._rewritten(layer, made)]
    return found


def test_against_whole_layers():
    rng = random.Random(5)
    parts = [
        "%25", "%", "25", "5c", "%5c", "u0025", "\\u005c", "\\", "&amp;", "amp;", "&#37;", "#37;", "&#1;", "%41", "%2541", "AKIA", "Q7" * 8, "api_key", "token=", "secret = ", "abcdefgh1", "deadbeef" * 4,
        "0a" * 3, " ", ", ", "\n", "x", "%5a", "%5", "%3", "35", "%35", "%32", "%61", "password", ":", '"', "%c3%a9", "%ff%fe", "%00", "%41%00", "\\ud83d", "\\ude00", "\\u{25}", "x25", "&quot;", "%1f%8b",
        base64.b64encode(f"see {SECRET} end".encode()).decode(), base64.b64encode(f"k {SECRET} end".encode("utf-16-le")).decode(),
    ]
    wraps = [lambda c: "".join(f"%{b:02x}" for b in c.encode()), lambda c: f"\\u{ord(c):04x}", lambda c: f"&#{ord(c)};", lambda c: f"\\x{ord(c):02x}"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        for wrap in rng.choices(wraps, k=rng.randrange(4)):
            text = "".join(wrap(c) if rng.random() < 0.5 else c for c in text) if len(text) < 2000 else text
        every, got = _layered(text), set(find_secrets(text)[1])
        assert got <= every, text
        # Left out are ends of what was found with more before it, or such ends as a whole where what is in them was found.
        assert all(any(k == j and (a <= c and d <= b or b == d and c <= a < d) for a, b, k in got) for c, d, j in every - got), text


def test_deep_layers_take_time_in_proportion():
    start = time.perf_counter()
    for text in ("%" + "25" * 50_000 + "zz", "%3" * 30_000 + "%35", "".join("a%" + "25" * d + "61" for d in range(250))):
        assert find_secrets(text)[0] is not None
    assert time.perf_counter() - start < 60
