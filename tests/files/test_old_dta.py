"""Old Stata releases, built byte by byte and, where it can, read by pandas too."""

import struct

import pandas as pd
import pytest

import statloom
from statloom.sources.dta import Dta

NAMES, LETTERS = ["id", "small", "x", "txt"], {"long": b"l", "byte": b"b", "double": b"d", "str5": bytes([127 + 5])}
CODES = {"long": 253, "byte": 251, "double": 255, "str5": 5}


def old(path, release, end=">"):
    """Three rows of a long, a byte, a double and a text; a label set for the byte."""
    name, fmt = (33 if release >= 110 else 9), (49 if release >= 114 else 12 if release > 104 else 7)
    label, pad = (81 if release > 105 else 32), lambda s, n: s.encode().ljust(n, b"\0")
    kinds = ["long", "byte", "double", "str5"]
    out = bytes([release, 1 if end == ">" else 2, 1, 0]) + struct.pack(end + "H", 4) + struct.pack(end + "I", 3) + pad("data label", label)
    out += pad("01 Jan 2000 00:00", 18) if release > 104 else b""
    out += bytes(CODES[k] for k in kinds) if release > 110 else b"".join(LETTERS[k] for k in kinds)
    out += b"".join(pad(n, name) for n in NAMES) + bytes(10) + b"".join(pad(f, fmt) for f in ("%8.0g", "%8.0g", "%9.0g", "%5s"))
    out += b"".join(pad(s, name) for s in ("", "lab", "", "")) + b"".join(pad(s, label) for s in ("the id", "", "", ""))
    out += (bytes(5) if release > 108 else bytes(3)) if release > 104 else b""
    missing = {"byte": 127 if release < 113 else 101, "long": 2147483647 if release < 113 else 2147483621}
    for k, (small, x, text) in enumerate([(1, 0.5, "abc"), (2, -1.25, "de"), (missing["byte"], None, "")]):
        out += struct.pack(end + "ib", k if k < 2 else missing["long"], small)
        out += struct.pack(end + "Q", 0x7FE0000000000000) if x is None else struct.pack(end + "d", x)
        out += pad(text, 5)
    if release > 104:
        texts = b"one\0two\0"
        body = struct.pack(end + "II", 2, len(texts)) + struct.pack(end + "IIii", 0, 4, 1, 2) + texts
        out += struct.pack(end + "I", len(body)) + pad("lab", name) + bytes(3) + body
    else:
        out += struct.pack(end + "H", 24) + pad("lab", name) + bytes(1) + pad("", 8) + pad("one", 8) + pad("two", 8)
    path.write_bytes(out)


@pytest.mark.parametrize("release", [104, 105, 108, 110, 111, 113, 114, 115])
@pytest.mark.parametrize("end", ["<", ">"])
def test_old_releases(spark, tmp_path, release, end):
    path = tmp_path / "o.dta"
    old(path, release, end)
    got = [tuple(r) for r in statloom.scan(spark, str(path)).collect()]
    assert got == [(0, 1, 0.5, "abc"), (1, 2, -1.25, "de"), (None, None, None, "")]
    assert [r[0] for r in statloom.scan(spark, str(path), columns=["small"], value_labels_as_strings=True).collect()] == ["one", "two", None]
    s = Dta(str(path))
    assert s.label == "data label" and s.columns[0].label == "the id" and s.release == release
    if release in (105, 108, 111, 113, 114, 115):
        back = pd.read_stata(path, convert_categoricals=False)
        assert back["x"].tolist()[:2] == [0.5, -1.25] and back["txt"].tolist() == ["abc", "de", ""]
