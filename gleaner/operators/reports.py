"""Markdown reports of small collected aggregates. Rows are collected by the caller; null rates are a dash."""

from __future__ import annotations

from collections.abc import Iterable

DASH = "—"


def cell(value) -> str:
    """A value in a table: dashes for nulls, shares as percentages, bars and line ends escaped."""
    if value is None:
        return DASH
    text = f"{value:.1%}" if isinstance(value, float) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(rows: Iterable, columns: dict[str, str]) -> str:
    """columns: a row's field and its heading."""
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def cut(text: str | None, limit: int) -> str:
    """A text of at most ``limit`` characters, the last of them an ellipsis where something is missing."""
    text = text or ""
    return text if len(text) <= limit else text[: limit - 1] + "…"


def reconciliation(candidates: int, filtered: int, selected: int, produced: int) -> str:
    """How checks add up: what was filtered and selected, and what of the selected came back."""
    ok = candidates == filtered + selected and 0 <= produced <= selected
    return f"candidates {candidates} = filtered {filtered} + selected {selected}; selected = produced {produced} + missing {selected - produced}" + ("" if ok else " (does not add up)")


def preparation(total: int, dispositions: list, structures: list, lengths: list, reasons: list) -> str:
    """The report of an export: what became of the traces, their structure and lengths, and why some are held back."""
    by = {r["disposition"]: r["traces"] for r in dispositions}
    head = f"{total} traces: {by.get('passed_sample', 0)} for training, {by.get('failed_sample', 0)} failed, {by.get('quarantine', 0)} to review, {by.get('duplicate', 0)} duplicates."
    parts = [
        "# Data preparation", head, "## Structure", table(structures, {"scenario": "scenario", "samples": "samples", "single_turn": "one turn", "multi_turn": "several", "zero_turn": "none"}),
        "## Lengths", table(lengths, {"scenario": "scenario", "measure": "measure", "min": "min", "median": "median", "p90": "P90", "max": "max"}), "## Held back",
    ]
    return "\n\n".join([*parts, "\n".join(f"- `{cut(r['reason'], 120)}`: {r['traces']}" for r in sorted(reasons, key=lambda r: (-r["traces"], r["reason"]))) or "Nothing."]) + "\n"


def scoring(rates: list, scenarios: list, failures: list, combinations: list, selection: tuple[int, int, int, int], top: int = 10) -> str:
    """The report of a scoring run: rates by check and scenario, failures and their most frequent combinations."""
    parts = [
        "# Scores", reconciliation(*selection), "## Checks", table(rates, {"check_id": "check", "passed": "passed", "failed": "failed", "pass_rate": "rate"}), "## Scenarios",
        table(scenarios, {"category": "category", "planned": "planned", "covered": "covered", "macro_pass_rate": "mean rate"}), "## Failures",
        table(failures, {"check_id": "check", "failures": "failures", "samples": "samples", "failure_rate": "rate"}), "## Combinations",
        table(sorted(combinations, key=lambda r: (-r["samples"], r["combination"]))[:top], {"combination": "checks", "samples": "samples"}),
    ]
    return "\n\n".join(parts) + "\n"


def coverage(cases: list, reasons: list) -> str:
    """The report of a simulator's rules: how often each case was triggered, and why others weren't."""
    shown = {"preset": "preset", "rule_id": "rule", "turn": "turn", "entity_name": "device", "outcome": "outcome", "configured": "configured", "triggered": "triggered", "unused": "unused", "trigger_rate": "rate"}
    order = sorted(cases, key=lambda r: (r["preset"], r["rule_id"], r["turn"], r["entity_id"], r["outcome"]))
    return "\n\n".join(["# Rule coverage", table(order, shown), "## Unused", table(sorted(reasons, key=lambda r: (r["sample_id"], r["rule_id"])), {"sample_id": "sample", "rule_id": "rule", "reason": "reason"})]) + "\n"


def repeats(tasks: list, planned: int) -> str:
    """The report of repeated runs: attempts that were scored, and tasks by category."""
    done = sum(r["completed"] for r in tasks)
    kinds: dict[str, int] = {}
    for r in tasks:
        kinds[r["category"]] = kinds.get(r["category"], 0) + 1
    rows = [{"category": k, "tasks": n} for k, n in sorted(kinds.items())]
    return "\n\n".join(["# Repeated runs", f"{done} of {planned} attempts scored, {planned - done} open.", table(rows, {"category": "category", "tasks": "tasks"})]) + "\n"
