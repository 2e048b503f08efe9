import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from foliograph.llm import exact_dedup, packing, toxicity

ROOT = Path(__file__).resolve().parents[2]


def shingles(text):
    """Distinct five-word shingles of the lower-cased text; of fewer words, all of them as one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id: r.score for r in toxicity.toxicity(whole, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    clean = {r.doc_id: r.text.translate({65 + i: 97 + i for i in range(26)}) for r in whole.collect() if scored[r.doc_id] < toxicity.THRESHOLD}
    last = {t: i for i, t in sorted(clean.items())}
    assert {r.doc_id for r in before.select("doc_id").collect()} == set(last.values())
    sets = {i: shingles(t) for t, i in last.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if alike(sets[a], sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, set()).add(i)
    assert len(groups) < len(sets) and all(len(kept & g) == 1 for g in groups.values()) and kept <= set(sets)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept


def test_stages_with_odd_rows(spark, docs, no_docs, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows go through all stages; so does an empty table."""
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for name, frame in (("odd", docs), ("none", no_docs)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    placed = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert placed.count() >= placed.select("doc_id").distinct().count() >= 8
    ids = {r.doc_id for r in placed.collect()}
    assert 5 not in ids and 2 not in ids and 8 in ids and 9 in ids


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "foliograph"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "foliograph/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_operators_are_registered():
    import __spark_entry__ as e

    names = [k for k in e.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert exact_dedup and packing
