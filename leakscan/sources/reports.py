"""Report sinks: the metric tables as CSV, a JSON bundle and an HTML page. The tables are small aggregates: models x categories."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame

from leakscan import dims as D
from leakscan.operators import metrics, views
from leakscan.operators.probes import first_each


def bundle(records: DataFrame) -> dict:
    """Summary (highest score first, then model), categories in order, two sample answers a cell; missing values as null."""
    rows = lambda x: [r.asDict() for r in x.collect()]
    order = {c: i for i, c in enumerate(D.CATEGORIES)}
    return {
        "meta": rows(views.run_meta(records))[0],
        "thresholds": {"low": D.LOW, "high": D.HIGH},
        "pri": D.RISK,
        "category_order": D.CATEGORIES,
        "summary": sorted(rows(metrics.summary(records)), key=lambda r: (-(r["aggregate_rwmer"] or 0), r["model"])),
        "per_category": sorted(rows(metrics.per_category(records)), key=lambda r: (r["model"], order.get(r["category"], 99))),
        "mer_long": sorted(rows(metrics.mer_long(records)), key=lambda r: (r["model"], order.get(r["category"], 99), r["condition"])),
        "sample_io": rows(first_each(records, ["model", "category", "condition", "hit"], 2).select("model", "category", "condition", "hit", "expected", "output")),
    }


def write_csvs(found: dict, folder: str) -> list[str]:
    """UTF-8 with a byte order mark."""
    import csv

    os.makedirs(folder, exist_ok=True)
    out = []
    for name in ("summary", "per_category", "mer_long"):
        out.append(os.path.join(folder, f"{name}.csv"))
        with open(out[-1], "w", encoding="utf-8-sig", newline="") as f:
            rows = found[name]
            w = csv.DictWriter(f, list(rows[0]) if rows else [])
            w.writeheader()
            w.writerows(rows)
    return out


def write_json(found: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=1)


COLOURS = {"Low": "#2e7d32", "Medium": "#ef6c00", "High": "#c62828"}


def page(found: dict, title: str = "Leak audit") -> str:
    """One HTML page: verdicts, and a table of categories."""
    e = lambda v: html.escape("—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    table = lambda rows, cols: "<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in cols) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(r[c])}</td>" for c in cols) + "</tr>" for r in rows) + "</table>"
    verdicts = "".join(f'<li><b>{e(r["model"])}</b>: <span style="color:{COLOURS[r["risk_band"]]}">{e(r["risk_band"])}</span> ({e(r["aggregate_rwmer"])})</li>' for r in found["summary"])
    cats = table(found["per_category"], ["model", "category", "pri", "mer_zh2zh", "mer_en2zh", "clmd", "rwmer"])
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><ul>{verdicts}</ul>{cats}{table(found['sample_io'], ['model', 'category', 'condition', 'hit', 'expected', 'output'])}"


def highlight(output: str | None, expected: str | None) -> str:
    """Escaped output with the expected value marked, whatever its case."""
    text, value = output or "", expected or ""
    at = text.upper().find(value.upper()) if value else -1
    if at < 0:
        return html.escape(text)
    parts = text[:at], text[at : at + len(value)], text[at + len(value) :]
    return f"{html.escape(parts[0])}<mark>{html.escape(parts[1])}</mark>{html.escape(parts[2])}"


_DASHBOARD = """<!doctype html><meta charset=utf-8><title>%(title)s</title>
<style>body{font:14px sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}mark{background:#fd6}</style>
<h1>%(title)s</h1><p id=meta></p><label>model <select id=model></select></label> <label>category <select id=category></select></label>
<table id=scores></table><table id=cells></table><h2>Answers</h2><div id=answers></div>
<script type="application/json" id=found>%(data)s</script>
<script>
const found = JSON.parse(document.getElementById("found").textContent), at = id => document.getElementById(id);
const put = (parent, tag, text) => { const e = parent.appendChild(document.createElement(tag)); e.textContent = text; return e; };
const shown = v => v == null ? "\u2014" : typeof v == "number" ? v.toFixed(4) : v;
function table(id, rows, columns) {
  const t = at(id); t.replaceChildren();
  const head = put(t, "tr", ""); columns.forEach(c => put(head, "th", c));
  rows.forEach(r => { const tr = put(t, "tr", ""); columns.forEach(c => put(tr, "td", shown(r[c]))); });
}
function marked(parent, text, value) {
  const i = value ? text.toUpperCase().indexOf(value.toUpperCase()) : -1;
  if (i < 0) { parent.append(text); return; }
  parent.append(text.slice(0, i)); put(parent, "mark", text.slice(i, i + value.length)); parent.append(text.slice(i + value.length));
}
function draw() {
  const m = at("model").value, c = at("category").value, fits = r => (!m || r.model == m) && (!c || !r.category || r.category == c);
  table("scores", found.summary.filter(fits), ["model", "aggregate_rwmer", "mean_clmd", "risk_band"]);
  table("cells", found.per_category.filter(fits), ["model", "category", "pri", "mer_zh2zh", "mer_en2zh", "clmd", "rwmer"]);
  at("answers").replaceChildren();
  found.sample_io.filter(fits).forEach(r => { const p = put(at("answers"), "p", r.model + " / " + r.category + " / " + r.condition + ": "); marked(p, r.output || "", r.expected); });
}
for (const [id, values] of [["model", found.summary.map(r => r.model)], ["category", found.category_order]]) {
  ["", ...values].forEach(v => { put(at(id), "option", v || "all").value = v; }); at(id).onchange = draw;
}
at("meta").textContent = Object.entries(found.meta || {}).map(([k, v]) => k + ": " + v).join("; ");
draw();
</script>"""


def dashboard(found: dict, title: str = "Leak audit") -> str:
    """A page that holds the bundle as JSON and draws its tables anew as a model or a category is chosen."""
    data = json.dumps(found, ensure_ascii=False).replace("<", "\\u003c")
    return _DASHBOARD % {"title": html.escape(title), "data": data}


def read_found(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def demo_page(selftest: list[dict], by_kind: list[dict], replay: list[dict], disagreement: list[dict], title: str = "Detector and replay") -> str:
    """One page of what an offline demonstration shows: confusion of both rules, the kinds of cases, what stored answers come to with the first hits, and where the rules differ."""
    cell = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        cols = [c for c in rows[0] if c != "examples"]
        head = "".join(f"<th>{html.escape(c)}</th>" for c in cols)
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(cell(r[c]))}</td>" for c in cols) + "</tr>" for r in rows) + "</table>"

    examples = "".join(f"<li>{html.escape(str(r['model']))}, {html.escape(e['category'])}: {highlight(e['output'], e['expected'])}</li>" for r in replay for e in r.get("examples") or ())
    parts = [("Self-test", table(selftest)), ("By kind of case", table(by_kind)), ("Replay", table(replay)), ("First hits", f"<ul>{examples}</ul>"), ("Where the rules differ", table(disagreement))]
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(f"<h2>{h}</h2>{body}" for h, body in parts)


def combined_summary(bundles: dict[str, dict]) -> dict:
    """One document over several bundles: scores, differences and categories by label; a label is matched with the bundle's first model."""
    first = {label: b["summary"][0] for label, b in bundles.items() if b["summary"]}
    return {
        "conditions": {k: r["aggregate_rwmer"] for k, r in first.items()},
        "clmd": {k: r["mean_clmd"] for k, r in first.items()},
        "per_category": {k: {r["category"]: r for r in bundles[k]["per_category"] if r["model"] == first[k]["model"]} for k in first},
    }
