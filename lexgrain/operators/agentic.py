"""Search in rounds: plan, retrieve, grade, decide, refine, with bounded calls to a model.

The searches are functions that run Spark jobs and return at most ``k`` rows, so the
state that the rounds carry on the driver is bounded by :class:`Limits`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from lexgrain.operators.extraction import first_json

Model = Callable[[str], object]
#: A row of a search: clause id, score, text.
Row = tuple[int, float, str]
#: One search: (query, k) -> rows, best first.
Search = Callable[[str, int], list[Row]]
VERDICTS = ("relevant", "partial", "irrelevant")
#: Words by which a query asks for a section, and what is looked up as a number.
SECTION_WORDS = re.compile(r"\b(?:раздел|статья|глава|оглавлени)", re.I)
NUMBERS = re.compile(r"\d+(?:[.,]\d+)?\s*%?")


@dataclass
class Limits:
    top_k: int = 8
    rounds: int = 3
    calls: int = 8
    candidates: int = 30
    batch: int = 10
    snippet: int = 800


@dataclass
class Found:
    """Result rows (clause_id, score, verdict, text) and how the search went."""

    rows: list[tuple[int, float, str, str]] = field(default_factory=list)
    rounds: int = 0
    calls: int = 0
    degraded: bool = False
    trace: list[dict] = field(default_factory=list)


def strings(value, most: int) -> list[str]:
    """Up to ``most`` strings of a list that are not blank; anything else gives none."""
    items = value if isinstance(value, list) else []
    return [str(x).strip() for x in items if x is not None and str(x).strip()][:most]


def content_text(content) -> str:
    """Text of a model's answer: a string, or the texts of its content blocks in order."""
    if isinstance(content, str):
        return content
    if isinstance(content, (list, tuple)):
        return "".join(b if isinstance(b, str) else str(b.get("text") or "") for b in content if isinstance(b, (str, dict)))
    return "" if content is None else str(content)


def keep_best(rows: Iterable[Row], into: dict[int, Row]) -> None:
    """Enter rows by clause; a clause keeps its best score, of equal ones the first."""
    for row in rows:
        if row[0] not in into or row[1] > into[row[0]][1]:
            into[row[0]] = row


def candidates(query: str, search: Search, grep: Search, scoped: Search | None = None) -> list[Row]:
    """Rows that a query finds: by meaning, by the first three numbers in it (25 % too)
    and, where it asks for a section, within the nearest one (``scoped``)."""
    found = list(search(query, 10))
    for number in NUMBERS.findall(query)[:3]:
        found += grep(re.escape(number.strip()), 5)
    if scoped is not None and SECTION_WORDS.search(query):
        found += scoped(query, 5)
    return found


@dataclass
class Grades:
    """Verdicts by clause, aspects that graded clauses cover (by position), what they lack."""

    of: dict[int, str] = field(default_factory=dict)
    covered: set[int] = field(default_factory=set)
    notes: list[str] = field(default_factory=list)

    def take(self, answer, batch: list[Row]) -> bool:
        """Enter a model's list of verdicts; False if it has none that can be used.

        An item names its candidate by the first number in ``id``; items with another
        verdict than the known ones, or about no candidate, leave theirs ungraded.
        """
        usable = False
        for item in answer if isinstance(answer, list) else ():
            number = re.search(r"\d+", str(item.get("id", ""))) if isinstance(item, dict) else None
            verdict = str(item.get("verdict", "")).strip().lower() if number else ""
            if verdict not in VERDICTS or not 1 <= int(number[0]) <= len(batch):
                continue
            usable = True
            self.of[batch[int(number[0]) - 1][0]] = verdict
            if verdict != "irrelevant":
                aspects = (str(a).strip() for a in item.get("aspects") or ())
                self.covered |= {int(a) - 1 for a in aspects if re.fullmatch(r"-*\d+", a) and a.count("-") < 2}
            self.notes += strings([item.get("missing")], 1)
        return usable

    def enough(self, aspects: list[str], top_k: int) -> bool:
        """Whether to stop: relevant clauses enough, or every aspect covered."""
        good = sum(v == "relevant" for v in self.of.values())
        return good >= top_k or self.covered >= set(range(len(aspects)))


def agentic_search(
    prompt: str, search: Search, grep: Search, model: Model | None, limits: Limits = Limits(), scoped: Search | None = None
) -> Found:
    """Search with a model that plans queries and grades clauses.

    Without a model the result is the plain search.  A plan or a grading that can't be read,
    that fails or for which no call is left gives the plain search too, as degraded; a
    refinement like that only ends the rounds.  If nothing is accepted, the
    plain search stands.
    """
    out = Found()

    def plain(degraded: bool) -> Found:
        out.rows = [(c, s, "", t) for c, s, t in search(prompt, limits.top_k)]
        out.degraded = degraded
        return out

    def ask(step: str, text: str):
        """Parsed answer of the model, None if there is none."""
        if out.calls >= limits.calls:
            out.trace.append({"step": step, "error": "no calls left"})
            return None
        out.calls += 1
        try:
            answer = first_json(content_text(model(f"{step}\n{text}")))
        except Exception as e:  # noqa: BLE001 whatever fails in the model, the search goes on without it
            out.trace.append({"step": step, "error": f"{type(e).__name__}: {e}"})
            return None
        out.trace.append({"step": step, "parsed": answer is not None})
        return answer

    if model is None:
        return plain(False)
    plan = ask("PLAN", prompt)
    if not isinstance(plan, dict):
        return plain(True)
    queries = strings(plan.get("queries"), 3) or [prompt]
    aspects = strings(plan.get("aspects"), 6) or [prompt]
    numbered = "\n".join(f"{i}. {a}" for i, a in enumerate(aspects, 1))
    pool: dict[int, Row] = {}
    grades = Grades()
    for out.rounds in range(1, max(1, limits.rounds) + 1):
        fresh: dict[int, Row] = {}
        for query in queries:
            keep_best(candidates(query, search, grep, scoped), fresh)
        ordered = sorted(fresh.values(), key=lambda r: (-r[1], r[0]))[: limits.candidates]
        keep_best(ordered, pool)
        batch = [r for r in ordered if r[0] not in grades.of][: limits.batch]
        if batch:
            listing = "\n".join(f"C{i}: {text[: limits.snippet]}" for i, (_, _, text) in enumerate(batch, 1))
            if not grades.take(ask("GRADE", f"{prompt}\n{numbered}\n{listing}"), batch):
                return plain(True)
        if grades.enough(aspects, limits.top_k) or out.rounds == limits.rounds or out.calls >= limits.calls:
            break
        missing = [a for i, a in enumerate(aspects) if i not in grades.covered]
        refined = ask("REFINE", "\n".join([prompt, *missing, *grades.notes[-5:]]))
        queries = strings(refined.get("queries"), 3) if isinstance(refined, dict) else []
        if not queries:
            break
    kept = [(c, s, grades.of[c], t) for c, s, t in pool.values() if grades.of.get(c) in VERDICTS[:2]]
    kept.sort(key=lambda r: (VERDICTS.index(r[2]), -r[1], r[0]))
    out.rows = kept[: limits.top_k]
    return out if kept else plain(False)
