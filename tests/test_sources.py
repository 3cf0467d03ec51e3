import http.server
import json
import os
import threading
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan import cli
from leakscan import dims as D
from leakscan.operators import answers, corpus, evalset, inference, probes
from leakscan.plans import queries as audit
from leakscan.sources import backends, records, reports

SF = "/root/testdata/sf0.001"


def made(spark, n):
    return corpus.first_persons(corpus.persons(spark.range(n + 10).withColumnRenamed("id", "key"), "key"), n)


@pytest.mark.parametrize("lines", [False, True])
def test_corpus_round_trip(spark, tmp_path, lines):
    people = made(spark, 40)
    records.write_corpus(people, str(tmp_path / "c"), lines=lines, part=7)
    got = records.read_corpus(spark, str(tmp_path / "c"), lines)
    assert {tuple(r) for r in got.select(people.columns).collect()} == {tuple(r) for r in people.collect()}


def test_corpus_document_of_others(spark, tmp_path):
    doc = {"meta": {"n_persons": 1, "seed": 1, "categories": ["full_name"], "note": "x"}, "persons": [{"pid": 0, "full_name": "王伟", "extra": 1}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    (r,) = records.read_corpus(spark, str(tmp_path / "d.json")).collect()
    assert (r.pid, r.full_name, r.mobile_phone) == (0, "王伟", None)


def test_corpus_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = {tuple(r) for r in records.cached_corpus(spark, path, 30).collect()}
    files = sorted(os.listdir(path))
    few = {tuple(r) for r in records.cached_corpus(spark, path, 12).collect()}
    assert len(first) == 30 and len(few) == 12 and few < first and sorted(os.listdir(path)) == files
    # a larger corpus begins with the same persons; another seed makes others
    assert first < {tuple(r) for r in records.cached_corpus(spark, path, 50).collect()}
    assert not first & {tuple(r) for r in records.cached_corpus(spark, path, 30, seed=5).collect()}


def test_self_test_counts(spark):
    x = evalset.labelset(made(spark, 140), 6)
    got = {r.rule: r for r in evalset.confusion(evalset.judged(x)).collect()}
    assert x.count() == 362
    assert [got["strict"][c] for c in ("tp", "fp", "tn", "fn")] == [114, 0, 242, 6]
    assert got["loose"].precision == pytest.approx(0.769, abs=0.005)


class Server(http.server.BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.calls.append((self.path, self.headers["Authorization"], body))
        said = body["messages"][-1]["content"]
        state = 503 if "busy" in said and len(Server.calls) % 2 else 400 if "bad" in said else 200
        self.send_response(state)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": f"to {said}"}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.calls.clear()
    yield f"http://127.0.0.1:{s.server_port}/v1"
    s.shutdown()


def test_http_sources(spark, server, monkeypatch):
    ask = lambda b, text: b([{"messages": [{"role": "user", "content": text}]}])
    b = backends.backend("openai_compat", "m", base_url=server, api_key="k", sleep=0.01)
    assert ask(b, "one") == ["to one"]
    path, key, body = Server.calls[0]
    assert (path, key) == ("/v1/chat/completions", "Bearer k") and body["temperature"] == 0 and body["seed"] == D.SEED and body["max_tokens"] == 64
    Server.calls.clear()
    assert ask(b, "busy") == ["to busy"] and len(Server.calls) == 2
    Server.calls.clear()
    with pytest.raises(RuntimeError, match="HTTP 400"):
        ask(b, "bad")
    assert len(Server.calls) == 1
    Server.calls.clear()
    with pytest.raises(RuntimeError, match="HTTP 400"):
        ask(backends.backend("hf_api", "m", base_url=server, api_key="k", sleep=0.01), "bad")
    assert len(Server.calls) == 3 and "seed" not in Server.calls[0][2]
    for name in (*backends.COMPATIBLE_KEYS, *backends.ROUTER_KEYS):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(RuntimeError, match="no key"):
        backends.backend("hf", "m")
    with pytest.raises(ValueError, match="unknown"):
        backends.backend("none", "m")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        backends.backend("dashscope", "m", api_key="k", device="cpu")
    assert "device" in str(seen[0].message)
    p = probes.matrix(made(spark, 2), ["full_name"])
    got = answers.remote(p, "m", b).select("template_id", "output", "error", F.element_at("messages", -1)["content"].alias("said")).collect()
    assert len(got) == 24 and all(r.output == f"to {r.said}" and r.error is None for r in got)


def test_replay_of_old_records(spark):
    rows = [("m", "full_name", "王伟", "王伟。"), ("m", "full_name", "王伟", "no"), ("m", "mobile_phone", "13800000000", None)]
    x = spark.createDataFrame(rows, "model string, category string, expected string, output string")
    (r,) = answers.replayed(x).collect()
    assert (r.n, r.hits) == (3, 1)
    (e,) = r.examples
    assert (e.pid, e.template_id, e.condition, e.output) == (0, "A1", "zh2zh", "王伟。")
    assert answers.replayed(x.limit(0)).collect() == []


def test_bootstrap_against_brute_force(spark):
    rows = [("m", p, (p * 7) % 5, 5) for p in range(60)]
    x = spark.createDataFrame(rows, "model string, pid int, hits int, n int")
    b = 300
    w = spark.createDataFrame([(p,) for p in range(60)], "pid int").withColumn("s", inference.hashed(7, "boot", F.col("pid").cast("string"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)).cast("array<bigint>")))
    w = {(r.pid, r.b): r.w for r in w.withColumn("w", F.expr(inference.draws("s", "b"))).collect()}
    v = [sum(h * w[p, i] for _, p, h, _ in rows) / sum(5 * w[p, i] for _, p, _, _ in rows) for i in range(b)]
    (r,) = inference.bootstrap(x, inference.rate_statistic, b).collect()
    assert (r.replicates, r.low, r.high, r.se) == (b, *[pytest.approx(q) for q in np.percentile(v, [2.5, 97.5])], pytest.approx(np.std(v, ddof=1)))
    # the draws are Poisson: mean and variance 1, and independent of each other
    m = np.array([[w[p, i] for i in range(b)] for p in range(60)], float)
    assert abs(m.mean() - 1) < 0.03 and abs(m.var() - 1) < 0.06
    off = np.corrcoef(m) - np.eye(60)
    assert abs(off).max() < 0.3 and abs(off.mean()) < 0.01 and abs(np.corrcoef(m.T) - np.eye(b)).max() < 0.75


def test_rename_in_files(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"conditions": {"x": {"v": 1}, "old": {"v": 2}, "z": {}}}))
    b.write_text(json.dumps({"conditions": {"new": {}, "q": {}}}))
    paths = [str(a), str(b), str(tmp_path / "none.json")]
    # only files that have the old name count
    assert records.rename_in_files(paths, "old", "new", {"lots": 3}) == [str(a)]
    got = json.loads(a.read_text())["conditions"]
    assert list(got) == ["x", "new", "z"] and got["new"] == {"v": 2, "lots": 3}
    assert "old" in json.loads((tmp_path / "a.json.bak").read_text())["conditions"]
    with pytest.raises(ValueError, match="exists"):
        records.rename_in_files([str(a)], "x", "new")
    (tmp_path / ".env").write_text("# c\nA=1\n\nexport B='two words'\nbroken\n")
    assert records.read_settings(str(tmp_path / ".env")) == {"A": "1", "B": "two words"} and records.read_settings("/no/such") == {}


def test_record_files(spark, tmp_path):
    head = "model,category,condition,type,template_id,pid,hit,match_method,expected,output\n"
    for i, h in enumerate(("true", "1", "True")):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / f"records_{i}.csv").write_text(f"{head}m{i},full_name,zh2zh,A,A1,{i},{h},exact,a,b\n", encoding="utf-8-sig")
    read = lambda **k: {r.model: r.hit for r in records.read_csv(spark, str(tmp_path), recursive=True, **k).collect()}
    assert read() == {"m0": True, "m1": True, "m2": True}
    assert read(files=2) == {"m0": True, "m1": True}
    assert read(strict_true=True) == {"m0": True, "m1": False, "m2": True}


def test_stats_and_bundles(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"conditions": {"a": {"rwmer": {"point": 0.3, "lo": 0.2, "hi": 0.4, "width": 0.2}}, "b": {"rwmer": {"point": 0.0}}}}))
    assert [(r.condition, r.hi) for r in records.read_stats(spark, str(tmp_path / "s.json")).collect()] == [("a", 0.4)]
    found = reports.bundle(audit.records(spark, SF).where("pid < 9"))
    reports.write_json(found, str(tmp_path / "r.json"))
    assert records.read_bundle(spark, str(tmp_path / "r.json"), "per_category").count() == 14
    assert found["meta"]["total_queries"] == sum(r["n"] for r in found["mer_long"])
    page = reports.dashboard(reports.read_found(str(tmp_path / "r.json")), "<t>")
    inner = page.split('id=found>')[1].split("</script>")[0]
    assert json.loads(inner) == json.loads(json.dumps(found)) and "&lt;t&gt;" in page
    both = reports.combined_summary({"x": found, "y": found})
    assert both["conditions"]["x"] == found["summary"][0]["aggregate_rwmer"] and set(both["per_category"]["y"]) == set(D.CATEGORIES)
    assert reports.highlight("a <B> ab", "AB") == "a &lt;B&gt; <mark>ab</mark>" and reports.highlight(None, "x") == ""


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    assert cli.main(["generate", "--n-entries", "20", "--out", str(tmp_path / "c")]) == 0
    assert records.read_corpus(spark, str(tmp_path / "c")).count() == 20
    assert cli.main(["audit", "--n-entries", "35", "--models", "qwen2.5-3b", "--data", str(tmp_path / "d"), "--out", str(tmp_path / "a")]) == 0
    assert {"report.html", "dashboard.html", "results.json", "summary.csv"} <= set(os.listdir(tmp_path / "a"))
    cols = ["model", "category", "condition", "type", "template_id", "pid", "hit", "match_method", "expected", "output"]
    records.write_csv(audit.records(spark, SF).where("pid < 4").select(cols), str(tmp_path / "records.csv"))
    for i, f in enumerate(sorted((tmp_path / "records.csv").glob("part*.csv"))):
        f.rename(f.with_name(f"records{i}.csv"))
    assert cli.main(["replay", "--records", str(tmp_path / "records.csv"), "--out", str(tmp_path / "p")]) == 0
    text = (tmp_path / "p" / "demo.html").read_text(encoding="utf-8")
    assert "<mark>" in text and "114" in text
