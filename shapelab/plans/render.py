"""Verdicts for people and machines: text, JSON, an attestation statement, annotations."""

from __future__ import annotations

import json

CONFIDENCE = {3: "exact", 2: "measured", 1: "estimated", 0: "declared"}
MARKS = {"error": "x", "warn": "!", "info": "i"}


def human_count(n: int) -> str:
    """1234567 -> 1.2M."""
    for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return str(n)


def result(verdict: dict, findings: list[dict], digest: str | None = None) -> dict:
    """verdict(verdict, exit_code) and findings as one document, findings in a fixed order."""
    order = sorted(findings, key=lambda f: ({"error": 0, "warn": 1}.get(f["severity"], 2), f["code"], f["idx"]))
    problems = [f for f in order if f["severity"] not in MARKS]
    if verdict["verdict"] not in ("PASS", "WARN", "FAIL") or problems:
        raise ValueError("a verdict is PASS, WARN or FAIL and a severity is error, warn or info")
    return {"verdict": verdict["verdict"], "exit_code": verdict["exit_code"], "digest": digest, "findings": order}


def as_json(res: dict) -> str:
    return json.dumps(res, sort_keys=True, indent=2)


def as_text(res: dict) -> str:
    lines = [f"{res['verdict']}  ({len(res['findings'])} findings)"]
    for f in res["findings"]:
        lines.append(f" {MARKS[f['severity']]} {f['code']} {f.get('table_name') or '-'}: {f['message']}")
        lines += [f"    duration: {f['bucket']}"] if f.get("bucket") else []
        lines += [f"    rests on: {', '.join(f['depends_on'])} [{CONFIDENCE.get(f.get('confidence'), 'absent')}]"] if f.get("depends_on") else []
        lines += [f"    resolve: profile the source again with exact counts to raise {f['resolve']}"] if f.get("resolve") else []
    return "\n".join(lines)


def as_statement(res: dict, subject: str) -> dict:
    """An attestation of the verdict over the document with that digest."""
    kind, _, value = (res["digest"] or "sha256:").partition(":")
    return {"_type": "https://in-toto.io/Statement/v1", "subject": [{"name": subject, "digest": {kind: value}}], "predicate": {k: v for k, v in res.items() if k != "digest"}}


def _escaped(text: str, more: str = "") -> str:
    for c in "%\r\n" + more:
        text = text.replace(c, f"%{ord(c):02X}")
    return text


def annotations(res: dict, folder: str = "") -> list[str]:
    """Workflow commands, one for each finding, at the statement's file and line."""
    command = {"error": "error", "warn": "warning", "info": "notice"}
    return [f"::{command[f['severity']]} file={_escaped(folder + (f.get('file') or ''), ':,')},line={f.get('line') or 1},title={_escaped(f['code'], ':,')}::{_escaped(f['message'])}" for f in res["findings"]]


def summary(res: dict) -> str:
    cell = lambda s: str(s if s is not None else "-").replace("|", "\\|").replace("\n", " ")
    rows = [f"| {cell(f['severity'])} | `{cell(f['code'])}` | {cell(f.get('table_name'))} | {cell(f['message'])} | {cell(f.get('bucket'))} |" for f in res["findings"]]
    return "\n".join([f"**{res['verdict']}**", "", "| severity | code | table | message | estimate |", "|-|-|-|-|-|", *rows])
