import json

from tracewright.streaming import resume


def test_append_resumes_without_repeats(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def put(name, ids):
        rows = [{"id": i, "category": "a", "answer": str(i), "output": f"\\boxed{{{i + i % 2 * 50}}}", "at": "2026-01-01T00:00:00Z"} for i in ids]
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    put("1.json", range(6))
    resume.append(resume.scored_stream(spark, source), target, checkpoint).awaitTermination()
    put("2.json", [4, 5, 6, 7])
    resume.append(resume.scored_stream(spark, source), target, checkpoint).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert sorted(r["id"] for r in rows) == list(range(8))
    assert {r["id"] for r in rows if r["correct"]} == {0, 2, 4, 6}
