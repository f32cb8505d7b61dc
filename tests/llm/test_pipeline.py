"""The pipeline's stages against a plain version, one after the other, on odd rows."""

import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tests.llm.test_joins import text_set, union
from tests.llm.test_texts import DER, base
from tidemark.llm import quality, secrets, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, sequence_id string"


def documents(rng):
    words = lambda n: ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []

    def add(text, toxic=None, good=None, doc_id=None):
        doc_id = len(rows) if doc_id is None else doc_id
        rows.append((doc_id, text, "xx", "s", 7 if text is None else len(text), "x", "y", "z"))
        if toxic is not None:
            labels.append((doc_id, int(good), int(toxic)))

    for k in range(260):
        own, toxic, good = words(rng.randint(30, 80)), k % 4 == 0, k % 5 != 0
        if toxic:
            for w in ["idiot", "vexatron" + rng.choice("abc")]:
                own.insert(rng.randrange(len(own)), w)
        add(" ".join(own if good else [w.upper() + "!!" for w in own]), toxic, good)
    start = words(60)
    for more in (0, 0, 12, 18, 60):
        add(" ".join(start + words(more)), False, True)
    for text in ["password = hunter2hunter2 and " + " ".join(words(30)), " ".join(words(30)) + " " + DER.hex() + " end", " ".join(words(9000)), None, "", "  \n"]:
        add(text)
    add(" ".join(start), doc_id=0)
    rows.append(rows[-1])
    return rows, labels


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_equal_a_plain_version(spark, tmp_path):
    rows, labels = documents(random.Random(3))
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, KIND)
    docs.write.parquet(f"{folder}/documents.parquet")
    label = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    # Toxicity and quality: the same models, applied row by row.
    weights, model = toxicity.fit(docs, label)
    lexicon = toxicity.Lexicon(weights)
    left = [r for r in rows if model.score(toxicity.np.array([lexicon.features(r[1] or "")]))[0] < 0.5]
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == sorted(left, key=repr)
    assert 0.6 * len(rows) < len(left) < len(rows)
    docs = spark.createDataFrame(left, KIND)
    score = quality.fit(docs, label).scorer()
    left = [r for r in left if score(r[1] or "") >= 0.5]
    got = stages["quality"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == sorted(left, key=repr)
    assert len(left) > 100

    # Near copies: five-word shingles, 80 %, by all pairs; rows that share an id are one document.
    docs = spark.createDataFrame(left, KIND)
    sets = [text_set(r[1], 5) for r in left]
    pairs = [(left[i][0], left[j][0]) for i in range(len(left)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    names = union(pairs, {r[0] for r in left})
    kept = [r for r in left if names[r[0]] == r[0]]
    got = stages["near copies"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == sorted(kept, key=repr)
    assert len(kept) < len(left)

    # Secrets: base patterns by their text, and one key that only decoding finds.
    docs = spark.createDataFrame(kept, KIND)
    masked = []
    for r in kept:
        spans = [(s, e) for s, _, e in base(r[1] or "")]
        text = r[1]
        for s, e in reversed(spans):
            text = text[:s] + "[secret]" + text[e:]
        masked.append((r[0], text, *r[2:4], r[4] if text == r[1] else len(text), *r[5:]))
    got = stages["secrets"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == sorted(masked, key=repr)
    assert sum(a != b for a, b in zip(kept, masked, strict=True)) >= 1 and all(not secrets.scan(r[1] or "")[0] for r in masked)

    # Packing: every id of every text once, windows full but for the last few.
    docs = spark.createDataFrame(masked, KIND)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in masked]
    want = sorted((r[0], start, x) for r, own in zip(masked, ids, strict=True) for start, x in enumerate(own))
    parts, windows = [], {}
    by_doc = {}
    for r, own in zip(masked, ids, strict=True):
        by_doc.setdefault(r[0], []).append(own)
    for p in stages["packing"](spark, docs, folder).collect():
        own = next(o for o in by_doc[p.doc_id] if len(o) == p.doc_tokens and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in o[p.start : p.start + p.length])) == p.ids_crc32)
        parts += [(p.doc_id, p.start + k, x) for k, x in enumerate(own[p.start : p.start + p.length])]
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(parts) == want
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(windows) <= -(-len(want) // 4096) + 1

    # run() is the same stages over the same tables.
    whole = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in whole.collect()) == len(want)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, tmp_path, stage):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([], KIND)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)


def test_stage_names_in_order():
    assert [re.sub(r"\W", " ", name) for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near copies", "secrets", "packing"]
