"""The cheapest edits of a sequence of chat roles, by depth-first branch-and-bound.

Allowed sequences of role initials are ``(s?(ua)+)?``. An edit keeps a row, gives it the role
user or assistant, or deletes it; rows without text can be inserted anywhere. Of all cheapest
edits the ASCII-least string of their initials wins (``audit``), which fixes the result: whether
a kept or given role is ``u`` or ``a`` follows from the roles before it.

A sequence is read through four states: nothing yet, after ``s``, after ``u``, after ``a``. Two
equal audits of the same rows end in one state, and of two different audits of one cost none begins
the other, so the better of two prefixes that reach a state stays the better one whatever follows.
Inserts are made right before a row that stays, or at the end: moved behind a deletion the
initials are less, as ``D`` is before ``I``.
"""

from __future__ import annotations

from typing import NamedTuple

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Any state in which the sequence is whole; missing roles are inserted at the end.
WHOLE = 4
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserts needed before a role may follow, by state; a role that is not named cannot.
_INSERTS = (
    {"s": 0, "u": 0, "a": 1},
    {"u": 0, "a": 1},
    {"u": 1, "a": 0},
    {"u": 0, "a": 1},
)
#: Inserts that make the sequence whole.
_CLOSE = (0, 2, 1, 0)


class _Reached(dict):
    """Per state the best (cost, audit) that has reached one row."""


class Row(NamedTuple):
    initial: str  #: of the role, empty without one
    forced: bool  #: blank or seen before, so it has to go
    truncated: bool
    more: int  #: equal rows behind it, which all have to go


def _choices(row: Row, state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) of what can be done with a row, cheapest first."""
    found = [(DELETE, "D", state)]
    if not row.forced:
        extra = TRUNCATED * row.truncated
        for role, inserts in _INSERTS[state].items():
            if role == row.initial:
                found.append((KEEP + extra + INSERT * inserts, "I" * inserts + "K", _AFTER[role]))
            elif role != "s":
                found.append((REROLE + extra + INSERT * inserts, "I" * inserts + "R", _AFTER[role]))
    return sorted(found)


#: Lower than any real cost of an end that cannot be reached.
_NEVER = 1 << 60


def search(rows: list[Row], entry: int, end: int) -> tuple[int, str] | None:
    """Cost and audit of the best edits that lead from state ``entry`` to ``end``; None if none do.

    The search goes down the cheapest choice first and keeps open prefixes on a stack of its own.
    A prefix is cut if its cost and a lower bound of the rest exceed the incumbent, if both
    tie and its audit is not less, or if a better prefix has reached the same row in the same state.
    The bound takes the next row's cheapest choice in the state at hand, and for all rows behind
    it their cheapest choice in any state.
    """
    n = len(rows)
    choices = [[_choices(row, state) for state in range(4)] for row in rows]
    free = [0] * (n + 1)  # the rest if the state could be chosen anew before each row
    for i in range(n - 1, -1, -1):
        free[i] = free[i + 1] + min(options[0][0] for options in choices[i])

    def at_least(i: int, state: int) -> int:
        # The first two states are never entered again, so an end in one of them needs its own beginnings.
        if end in (EMPTY, SYSTEM) and state > end:
            return _NEVER
        if i == n:
            return INSERT * _CLOSE[state] if end == WHOLE else 0 if state == end else _NEVER
        return choices[i][state][0][0] + free[i + 1]

    best: tuple[int, str] | None = None
    reached = [_Reached() for _ in range(n + 1)]
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, state = stack.pop()
        bound = cost + at_least(i, state)
        if bound >= _NEVER or best and (bound > best[0] or bound == best[0] and audit > best[1]):
            continue
        if state in reached[i] and reached[i][state] <= (cost, audit):
            continue
        reached[i][state] = (cost, audit)
        if i == n:
            closed = (bound, audit + "I" * _CLOSE[state] if end == WHOLE else audit)
            best = closed if best is None else min(best, closed)
            continue
        options = [(cost + c, audit + letters, i + 1, after) for c, letters, after in choices[i][state]]
        # The most promising prefix is put on the stack last, so it is taken first.
        stack += sorted(options, key=lambda o: (o[0] + at_least(o[2], o[3]), o[1]), reverse=True)
    return best and _with_copies(rows, *best)


def _with_copies(rows: list[Row], cost: int, audit: str) -> tuple[int, str]:
    """The equal rows behind each row go as well; their letters stand behind the row's own."""
    if not any(row.more for row in rows):
        return cost, audit
    out, at = [], iter(rows)
    for letter in audit:
        out.append(letter)
        if letter != "I":
            out.append("D" * next(at).more)
    return cost + DELETE * sum(row.more for row in rows), "".join(out)


class Fold:
    """Join the pieces of one long sequence in order.

    Each piece brings the best (cost, audit) for pairs of an entry and an end state. Only what
    is undecided is held: as soon as all open ends come from one state at some piece, the pieces
    before it are settled and leave with their own part of the audit.
    """

    def __init__(self):
        self.open = {EMPTY: (0, "")}  # per state the best cost and the audit since the settled pieces
        self.pending: list[tuple[object, dict[int, tuple[int, str]]]] = []

    def add(self, tag: object, paths: dict[tuple[int, int], tuple[int, str]]) -> list[tuple[object, str]]:
        """Read the next piece; returns the (tag, audit) of the pieces that are settled now."""
        ends: dict[int, tuple[int, str, int, str]] = {}
        for (entry, end), (cost, audit) in paths.items():
            if entry in self.open:
                before, tail = self.open[entry]
                new = (before + cost, tail + audit, entry, audit)
                if end not in ends or new[:2] < ends[end][:2]:
                    ends[end] = new
        self.open = {end: new[:2] for end, new in ends.items()}
        self.pending.append((tag, {end: new[2:] for end, new in ends.items()}))
        return self._settle(set(self.open))

    def _settle(self, ends: set[int]) -> list[tuple[object, str]]:
        for i in range(len(self.pending) - 1, -1, -1):
            if len(ends) == 1:
                done = self._walk(i + 1, next(iter(ends)))
                gone = sum(len(audit) for _, audit in done)
                self.pending = self.pending[i + 1 :]
                self.open = {end: (cost, tail[gone:]) for end, (cost, tail) in self.open.items()}
                return done
            ends = {self.pending[i][1][end][0] for end in ends}
        return []

    def _walk(self, n: int, end: int) -> list[tuple[object, str]]:
        done = []
        for tag, back in reversed(self.pending[:n]):
            entry, audit = back[end]
            done.append((tag, audit))
            end = entry
        return done[::-1]

    def close(self) -> tuple[int, str, list[tuple[object, str]]]:
        """(cost, letters of the inserts at the end, the (tag, audit) of the pieces left)."""
        closed = {end: (cost + INSERT * _CLOSE[end], tail + "I" * _CLOSE[end]) for end, (cost, tail) in self.open.items()}
        end = min(closed, key=closed.__getitem__)
        return closed[end][0], "I" * _CLOSE[end], self._walk(len(self.pending), end)
