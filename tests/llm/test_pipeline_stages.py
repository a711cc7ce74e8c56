"""Each stage of the pipeline, on what the one before it kept, against a plain version of its decision."""

import itertools
import zlib

import numpy as np

from test_operators import edit
from vasculyze.llm import decontam


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = np.random.default_rng(11)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))
    texts = [say(60) for _ in range(30)]
    texts += [t + " end" for t in texts[:6]] + texts[6:9] + ["", None, "12 34 !!", "中文"]
    item = say(9)
    texts += [say(20) + " " + item.replace("a", "b", 1) + " " + say(20), say(10) + " " + item + " " + say(4)]
    rows = [(i, t, "en", ("x", "y", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name == "language":
            kept = {i: r for i, r in kept.items() if any(c.isalpha() for c in r[1] or "")}
        elif name == "near_duplicates":
            sets = {i: {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} for i, r in kept.items() if (ws := r[1].lower().split())}
            root = {i: i for i in sets}
            for i, j in itertools.combinations(sorted(sets), 2):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root = {k: min(root[i], root[j]) if v in (root[i], root[j]) else v for k, v in root.items()}
            kept = {i: r for i, r in kept.items() if root[i] == i}
        elif name == "benchmark_leaks":
            x = decontam.normal(item)
            kept = {i: r for i, r in kept.items() if edit(x, decontam.normal(r[1])) > len(x) * 8 // 100}
            assert len(kept) == 31
        elif name == "mixture":
            words = {s: sum(len(r[1].split()) for r in kept.values() if r[3] == s) for s in ("x", "y", None)}
            left, goal, weight = 1.5 * sum(words.values()), {}, {"x": 3, "y": 1, None: 2}
            while over := [s for s in weight if s not in goal and left * weight[s] / sum(weight[t] for t in weight if t not in goal) > 2 * words[s]]:
                goal |= {s: 2 * words[s] for s in over}
                left -= sum(goal[s] for s in over)
            goal |= {s: left * weight[s] / sum(weight[t] for t in weight if t not in goal) for s in weight if s not in goal}
            mixed = [tuple(r) for r in docs.collect()]
            assert set(mixed) <= set(kept.values()) and max(mixed.count(r) for r in kept.values()) <= 2
            for s, g in goal.items():
                assert abs(sum(len(r[1].split()) for r in mixed if r[3] == s) - g) <= 60
            continue
        if name != "token_shards":
            assert sorted(tuple(r) for r in docs.collect()) == sorted(kept.values())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r[0], [*tok.encode(r[1], add_special_tokens=False).ids, 0]) for r in sorted(mixed)]
    want, at = [], 0
    for i, x in ids:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect()) == want
