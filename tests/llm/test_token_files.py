"""Parts: rows of one doc_id and null doc_ids over several parts, clashing columns, files as described."""

import random
import zlib

import numpy as np

from cairn.llm import token_files
from cairn.llm.queries import vocabulary


def test_hot_ids_are_spread_over_parts_and_files_hold_what_is_read(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "READ_DOCUMENTS", 7)
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "house", "of", "ñandú", "42", "x."]) for _ in range(rng.randint(0, 9)))
    data = [(None, text(), 1, 2.0) for _ in range(120)] + [(7, text(), 1, 2.0) for _ in range(120)] + [(i, text(), 1, 2.0) for i in range(100, 160)]
    data += [(500, None, 1, 2.0), (501, "", 1, 2.0), (502, "long " * 50_000, 1, 2.0)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string, h int, part double").repartition(4)
    parts = token_files.write_token_files(df, path, end_id=2, folder=f"file://{tmp_path}", parts=12)
    assert len(parts) > 6 and max(p[3] for p in parts) < 120
    got = token_files.read_token_files(spark, parts).orderBy("start").collect()
    assert len(got) == len(data) and [r["doc_id"] for r in got] == sorted((x[0] for x in data), key=lambda x: -1 if x is None else x)
    at, ids = 0, []
    for _, name, base, documents, dtype in parts:
        offsets = np.fromfile(tmp_path / f"{name}.idx", "<i8")
        flat = np.fromfile(tmp_path / f"{name}.bin", dtype)
        assert base == at and len(offsets) == documents + 1 and offsets[-1] == len(flat)
        ids += [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at += len(flat)
    want = sorted((-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in data)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], x) for r, x in zip(got, ids, strict=True)) == want
    assert all(r["n_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(x, "<u4").tobytes()) for r, x in zip(got, ids, strict=True))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".part")]
