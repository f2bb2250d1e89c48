"""The pipeline's stages, each on all that the one before kept, against brute force."""

import hashlib
import random
import re
import struct
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import pytest

import corpus_pipeline
from statloom.llm import packing
from statloom.llm.common import table

from . import cases
from .test_text_operators import WORD, brute_bits, brute_components, held

SF = "/root/testdata/sf0.001"


def brute_language(rows):
    learn = [(r["lang"], r["text"]) for r in rows if not held(r["doc_id"], 5, 0) and r["lang"] is not None and r["text"] is not None]
    bits, langs, out = brute_bits(learn), sorted({x for x, _ in learn}), []
    for r in rows:
        if re.search(r"[^\W\d_]", r["text"] or ""):
            costs = [bits(x, r["text"]) for x in langs]
            if min(costs) <= 7.5 * len(r["text"].lower().encode()) + 64:
                out.append({**r, "lang": r["lang"] if r["lang"] is not None else langs[costs.index(min(costs))]})
    return out


def brute_exact(rows):
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        if k not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (best[k]["doc_id"] is None, best[k]["doc_id"] or 0):
            best[k] = r
    return list(best.values())


def brute_near(rows):
    groups = brute_components([(r["doc_id"], r["text"], None) for r in rows])
    return [r for r, (i, _, c) in zip(rows, groups) if i == c]


def brute_mixing(rows):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    order = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = Counter()
    for r in rows:
        total[r["source"]] += size(r)
    everything, target, open_ = sum(total.values()), {}, set(order)
    while True:  # reshare what the full ones can't take
        left = everything - sum(target.values())
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
        open_ -= set(full)
    left, weights = everything - sum(target.values()), sum(weight[x] for x in open_)
    target |= {s: left * weight[s] / weights for s in open_}
    out = []
    for s in order:
        own = [r for r in rows if r["source"] == s]
        copies = int(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, used = target[s] - copies * total[s], 0
        by_hash = defaultdict(list)
        for r in own:
            by_hash[int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}\n{r['text'] or ''}".encode()).hexdigest()[:15], 16)].append(r)
        open_now = True
        for h in sorted(by_hash):
            words = sum(map(size, by_hash[h]))
            take = open_now and (used + words <= rest or 2 * (rest - used) >= words)
            open_now = open_now and used + words <= rest
            used += words
            for r in by_hash[h]:
                out += [r] * (copies + bool(take and total[s]))
    return out


BRUTE = {"language": brute_language, "exact": brute_exact, "near": brute_near, "mixing": brute_mixing}


def key(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("real", [True, False])
def test_stages(spark, real):
    docs = table(spark, SF, "documents") if real else cases.frame(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF)
        found = [r.asDict() for r in out.collect()]
        if name == "packing":
            tokens = sum(r["length"] for r in found)
            encode = packing.Encoder(packing.tokenizer_path())
            pieces = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in found)
            for r in rows:
                ids = encode(r["text"] or "") + b"\1\0\0\0"
                pieces.subtract((r["doc_id"], a // 4, crc32(ids[a : a + 8192])) for a in range(0, len(ids), 8192))
                tokens -= len(ids) // 4
            assert tokens == 0 and not any(pieces.values())
            break
        assert out.columns == columns
        assert key(found) == key(BRUTE[name](rows)), name
        docs = spark.createDataFrame(found, docs.schema) if found else docs.limit(0)


def test_run_and_empty_tables(spark, tmp_path):
    cases.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark):
    names = "_k _h _row _salt _first row hash s k h again row_number level name one uid pos digest th class_id component copies threshold best doc id t".split()
    rows = [(k, t, "en", f"s{k % 2}", len(t), *range(len(names))) for k, t in enumerate([cases.prose(60, 1), cases.prose(60, 1) + " more", cases.prose(30, 2), cases.prose(30, 2), cases.prose(30, 3)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in names))
    columns, found = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        kept = out.collect()
        found.append(sorted(r["doc_id"] for r in kept))
        docs = spark.createDataFrame(kept, docs.schema)
    assert found[:3] == [[0, 1, 2, 3, 4], [0, 1, 2, 4], [0, 2, 4]]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(found[-1])


def test_encoder_remembers_little():
    encode = packing.Encoder(packing.tokenizer_path())
    r = random.Random(5)
    for k in range(100):  # all words differ; the last texts' ones are long
        words = ["".join(r.choices("bcdfghjklmnp", k=12 if k < 90 else 2000)) for _ in range(3000 if k < 90 else 100)]
        encode(" ".join(words))
    kept = [*encode.chunks.items(), *encode.parts.items()]
    assert len(encode.chunks) <= 100_000 and len(encode.parts) <= 500_000 and max(len(a) for a, _ in kept) <= 64
    assert encode(" ".join(words)) == b"".join(map(encode, words))
    assert encode(words[0]) == struct.pack(f"<{len(ids := encode.whole.encode(words[0], add_special_tokens=False).ids)}I", *ids)


class Asked:
    """A tokenizer's model that counts what it is asked for."""

    def __init__(self, model):
        self.model, self.times = model, Counter()

    def tokenize(self, text):
        self.times[text] += 1
        return self.model.tokenize(text)


def test_encoder_keeps_frequent_parts():
    encode = packing.Encoder(packing.tokenizer_path(), 100, 100)
    encode.model = asked = Asked(encode.model)
    r, frequent = random.Random(6), [f"{a}{b}" for a in "bcdf" for b in "aeiou"]
    for _ in range(100):  # 25 new words each time, more than there is room for
        encode(" ".join([*frequent, *("".join(r.choices("ghjklmnp", k=12)) for _ in range(25))]))
    assert [asked.times[w] for w in frequent] == [1] * len(frequent)
    assert sum(asked.times.values()) == len(frequent) + 2500 and len(encode.parts) + len(encode.parts.older) <= 100


def test_encoder_on_odd_texts():
    encode = packing.Encoder(packing.tokenizer_path(), 10, 20)
    r, some = random.Random(7), [*"'''stremvldS,.!-\" \t\n09²½", *"\x0b\x0c\x1c\x1f\x01\x7f\x85\xa0\xadéÉßİȺǅ̇́", *"ΣςAΩ你好’“—…　ﬁ<|>"]
    for k in range(4000):
        text = "".join(r.choices(some if k % 3 else some[:22], k=r.randrange(1, 25)))
        assert encode(text) == struct.pack(f"<{len(ids := encode.whole.encode(text, add_special_tokens=False).ids)}I", *ids), text


IDLE = """
import ctypes, re, types
import pandas as pd, pyarrow as pa
from statloom.llm import language_id
from tests.llm.cases import prose

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024

counts = pd.concat(language_id._count(iter([pd.DataFrame({"lang": list("abcdefgh"), "text": [prose(5000, k) for k in range(8)]})])))
run = language_id._predict(types.SimpleNamespace(value=language_id.Model(counts)))
base = prose(60_000, 9)
batches = [pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([base[i * 70 : i * 70 + 500 + i] for i in range(3000)])], ["doc_id", "text"])] * 3
ctypes.CDLL(None).malloc_trim(0)
before = held()
for _ in run(iter(batches)):
    pass
print(held() - before)
"""


def test_idle_worker_holds_little():
    out = subprocess.run([sys.executable, "-c", IDLE], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True).stdout
    assert float(out) < 10, out
