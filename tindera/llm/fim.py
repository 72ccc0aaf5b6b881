"""Fill-in-middle: a text is cut into prefix, middle and suffix, which change places around marks.

Units are a run of white space with the run of other characters after it, or white space at the end.  One automaton
finds what can end or begin a unit, the ASCII white space, together with the marks.  Between two such events
lies a run without any: the events' places alone give the number of units and where the k-th ends, and no list of units is made.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import batch, tidied

SEED = 42
#: Texts of a hundred that are rearranged, and of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SPACE = " \t\n\v\f\r"

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def automaton(marks: tuple[str, ...] = MARKS):
    """Over code points: white space has the value 1, marks have 0."""
    out = ahocorasick.Automaton()
    for c in SPACE:
        out.add_word(c, 1)
    for m in marks:
        out.add_word(m, 0)
    out.make_automaton()
    return out


class Events:
    """What the automaton found in a text: places of white space, and whether a mark occurs.

    A unit's run of other characters is the gap between two events that aren't neighbours, so the gaps are counted by arithmetic on
    the places.  White space at the end makes one unit more.
    """

    def __init__(self, found, length: int) -> None:
        self.marked = False
        self.length = length
        space = np.fromiter(self._space(found), np.int64)
        gap = np.diff(space, prepend=-1, append=length) > 1
        #: Where the runs of other characters end.
        self.ends = np.append(space, length)[gap]
        self.n = len(self.ends) + int(length > 0 and len(space) > 0 and space[-1] == length - 1)

    def _space(self, found):
        for at, kind in found:
            if kind:
                yield at
            else:
                self.marked = True

    def end_of(self, units: int) -> int:
        """Code points in the first units."""
        return 0 if not units else int(self.ends[units - 1]) if units <= len(self.ends) else self.length


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def rearranged(text: str, doc_id: int | None, machine, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(units, form, code points of prefix, of middle, output) of one text."""
    events = Events(machine.iter(text), len(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or events.marked or h3 % 100 >= rate:
        return events.n, "plain", None, None, text
    a, b = (events.end_of(k) for k in sorted((h1 % (events.n + 1), h2 % (events.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return events.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return events.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _kernel(seed: int, rate: int, suffix_first: int):
    def run(batches):
        machine = automaton()
        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                out.append((doc_id, *rearranged(text, doc_id, machine, seed, rate, suffix_first)))
                held += len(text)
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return batch(dict(zip(_SCHEMA.names, zip(*out))), _SCHEMA)


def rearrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Every text in the form in which it is trained on.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row: ``doc_id``, ``n`` (units), ``form`` (``plain``, ``psm``,
    ``spm``), ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and ``output``, the whole text.
    A null text is an empty one, and empty texts are plain; so are texts that hold a mark, which could not be taken apart again.
    A null doc_id draws as an empty number; equal rows get equal results; texts of any length are read whole.
    Nothing is shuffled; a task's rows depend on the task's own input alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(_kernel(seed, rate, suffix_first)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; built-in functions only, so that it doesn't share the kernel's code."""

    def after(mark: str, until: str | None) -> Column:
        begin = F.locate(mark, output) + len(mark)
        return output.substr(begin, F.length(output) if until is None else F.locate(until, output) - begin)

    psm = F.concat(after(PREFIX, SUFFIX), after(MIDDLE, None), after(SUFFIX, MIDDLE))
    spm = F.concat(after(PREFIX, MIDDLE), after(MIDDLE, None), after(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
