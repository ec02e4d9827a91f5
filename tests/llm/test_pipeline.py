"""The pipeline's stages on a small corpus, each on its own input."""

import corpus_pipeline
from docsift.llm import decontam, pii

EN = "the quick study of many small words that people often write in their letters and books about the weather"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows, passage = [], "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    for i in range(60):
        own = " ".join(f"{w}{i if k % 4 == 0 else ''}" for k, w in enumerate(EN.split()))
        rows.append((i, own, "en", f"s{i % 3}", len(own)))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[0][1] + " tail", "en", "s1", 1), (102, "#### 1234 ----", None, "s1", 1), (103, None, "en", None, 0)]
    rows += [(104, f"words before {passage} words after the passage here", "en", "s2", 1), (105, passage, "en", "s2", 1), (106, "write to joe.doe@mail.example.com about the books and letters", "en", "s2", 1)]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert set(seen["language"]) == ids - {102, 103}
    assert set(seen["near_duplicates"]) == ids - {102, 103, 100, 101}
    assert set(seen["decontamination"]) == ids - {102, 103, 100, 101, 105}
    assert "alpha" not in seen["decontamination"][104] and "words before" in seen["decontamination"][104]
    given = decontam.phrases([("1", passage)])
    import pyarrow as pa

    assert not decontam.find_all(pa.array(list(seen["decontamination"].values()), pa.large_string()), [given]).items
    assert "joe.doe" not in seen["privacy"][106] and pii.replace(seen["privacy"][106], pii.Feistel(pii.DEMO_KEY), undo=True)[0] == rows[-1][1]
    assert all(seen["privacy"][i] == seen["decontamination"][i] for i in seen["privacy"] if i != 106)
    assert set(seen["mixing"]) <= set(seen["privacy"])


def test_run(spark, tmp_path):
    rows, passage = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "copy_no" in out.columns and out.count() > 0


def test_stages_against_brute_force(spark, tmp_path):
    """Near duplicates, passages, values and copies of each stage's own input, worked out in plain Python."""
    import random
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import test_decontam
    import test_dedup

    from docsift.llm import mixing

    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(300)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 25)))) for i in range(6)]
    rows = []
    for i in range(120):
        own = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if rows and rng.random() < 0.4:
            own = rng.choice(rows)[1].split()
            own[rng.randrange(len(own))] = rng.choice(vocab)
        if rng.random() < 0.3:
            own += items[rng.randrange(6)][1].split()
        if rng.random() < 0.2:
            own += ["4111111111111111", "joe.doe@mail.example"]
        rows.append((i if rng.random() < 0.9 else rng.choice([None, 5, 7]), " ".join(own), "en", f"s{i % 4}", 1))
    rows += [(900, None, "en", "s1", 0), (901, "", "en", None, 0)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = spark.createDataFrame(rows, COLUMNS), dict(corpus_pipeline.STAGES)

    kept = stages["near_duplicates"](spark, docs, str(tmp_path)).collect()
    component = test_dedup.brute([(k, r[1]) for k, r in enumerate(rows)])
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(component[k][1] if test_dedup.shingles(r[1]) else ("none", k), []).append(r)
    got = [tuple(r) for r in kept]
    assert len(got) == len(groups) and all(sum(g in members for g in got) >= 1 for members in groups.values())
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        assert any(g in members and g[0] == (min(ids) if ids else None) for g in got)

    clean = stages["decontamination"](spark, spark.createDataFrame(kept, COLUMNS), str(tmp_path)).collect()
    before = {tuple(r): hit for r, hit in zip(kept, test_decontam.brute([r.text for r in kept], items), strict=True)}
    assert all(b[1] == 0 for b in test_decontam.brute([r.text for r in clean], items))
    untouched = [r for r, b in before.items() if b[1] == 0]
    assert set(untouched) <= {tuple(r) for r in clean} and len(untouched) < len(kept)

    private = stages["privacy"](spark, spark.createDataFrame(clean, COLUMNS), str(tmp_path)).collect()
    assert not any("4111111111111111" in (r.text or "") or "joe.doe@" in (r.text or "") for r in private)
    undone = sorted((pii.replace(r.text, pii.Feistel(pii.DEMO_KEY), undo=True)[0] if r.text else r.text or "") for r in private)
    assert undone == sorted(r.text or "" for r in clean)

    frame = spark.createDataFrame(private, COLUMNS)
    mixed = stages["mixing"](spark, frame, str(tmp_path)).collect()
    copies = sum(r.copies for r in mixing.mix_report(frame).collect())
    assert len(mixed) == copies and {r.text for r in mixed} <= {r.text for r in private}
    by_source = {}
    for r in mixed:
        by_source[r.source] = by_source.get(r.source, 0) + len((r.text or "").split())
    sizes = {}
    for r in private:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    longest = max(len((r.text or "").split()) for r in private)
    from test_mixing_urls import water_fill

    for source, target in water_fill(sizes).items():
        assert abs(by_source.get(source, 0) - target) <= longest
