"""Writers of reports and runs."""

from __future__ import annotations

import html
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_reports(report: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_run(result: dict, folder: str, name: str) -> str:
    """Keep the result of one run as a file named by its time; returns the run's id."""
    run_id = f"run_{time.time_ns() // 1_000_000}"
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    saved = {"run_id": run_id, "name": name, "saved_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "result": json.dumps(result, ensure_ascii=False, default=str)}
    (target / f"{run_id}.json").write_text(json.dumps(saved, ensure_ascii=False), encoding="utf-8")
    return run_id


def delete_run(folder: str, run_id: str) -> bool:
    file = Path(folder) / f"{Path(run_id).name}.json"
    if not file.exists():
        return False
    file.unlink()
    return True


def report_html(report: dict, findings: list[dict]) -> str:
    """One document's report as a page; all values are escaped."""
    esc = lambda x: html.escape(str(x))
    facts = "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in report.items())
    rows = "".join(f"<tr><td>{esc(f.get('finding_type'))}</td><td>{esc(f.get('severity'))}</td><td>{esc(f.get('title'))}</td><td>{f.get('confidence') or 0:.2f}</td></tr>" for f in findings)
    return f"<!doctype html><meta charset='utf-8'><title>Report</title><h1>Report</h1><table>{facts}</table><h2>Findings</h2><table><tr><th>Type<th>Severity<th>Title<th>Confidence</tr>{rows}</table>"


def marked(text: str, quote: str) -> str:
    """The text escaped, the first occurrence of a quote (whatever its case) marked."""
    at = text.lower().find(quote.lower()) if quote else -1
    if at < 0:
        return html.escape(text)
    end = at + len(quote)
    return f"{html.escape(text[:at])}<mark>{html.escape(text[at:end])}</mark>{html.escape(text[end:])}"


def marked_common(a: str, b: str, least_words: int = 3) -> str:
    """The first text escaped, with the runs of words marked that the second has too."""
    import difflib
    import re

    left, right = re.findall(r"\s+|\S+", a), re.findall(r"\s+|\S+", b)
    out, at = [], 0
    for block in difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks():
        words = sum(not x.isspace() for x in left[block.a : block.a + block.size])
        if words >= least_words:
            out.append(html.escape("".join(left[at : block.a])))
            out.append("<mark>" + html.escape("".join(left[block.a : block.a + block.size])) + "</mark>")
            at = block.a + block.size
    out.append(html.escape("".join(left[at:])))
    return "".join(out)
