r"""The first complete, non-blank ``\boxed{...}`` of a text that arrives in pieces.

The scanner reads every character once and keeps numbers in place of text: the
depth of braces so far, how much of ``\boxed{`` the end of the last piece
matched, the depths at which boxes are open, and whether the innermost has
anything but blanks in it.  A box that never closes hides none inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TAG = "\\boxed{"
_MARK = re.compile(r"\\boxed\{|[{}]")
#: Ids of a range, which share an entry of the state: one costs a few round trips between Python and the store.
RANGE_BITS = 10
#: What an entry holds of its rollouts, whatever the length of their texts.
STATE = "ids array<bigint>, n array<bigint>, done array<bigint>, depth array<bigint>, matched array<int>, filled array<boolean>, boxes array<array<bigint>>"


@dataclass
class Scanner:
    depth: int = 0
    matched: int = 0
    filled: bool = False
    boxes: list[int] = field(default_factory=list)

    def read(self, piece: str) -> bool:
        """Take the next piece; whether a box with content closes in it."""
        text = TAG[: self.matched] + piece
        new, end = self.matched, 0  # what comes before these is counted, or part of a mark
        for mark in _MARK.finditer(text):
            self.filled |= bool(text[max(new, end) : mark.start()].strip())
            end = mark.end()
            if mark[0] == TAG:
                self.boxes.append(self.depth)
                self.depth, self.filled = self.depth + 1, False
            elif mark[0] == "{":
                self.depth, self.filled = self.depth + 1, True
            else:
                self.depth -= 1
                if self.boxes and self.boxes[-1] == self.depth:
                    self.boxes.pop()
                    if self.filled:
                        return True
                self.filled = True  # what closed is content of the box around it
        self.filled |= bool(text[max(new, end) :].strip())
        most = min(len(TAG) - 1, len(text) - end)
        self.matched = next(k for k in range(most, -1, -1) if text.endswith(TAG[:k]))
        return False


#: Characters at either end of plain text that may be part of a mark begun or ended in another piece.
_EDGE = len(TAG) - 1
_PLAIN = re.compile(r"[^\\{}]{%d,}" % (2 * _EDGE + 2))
MERGED = "seq_id long, pos long, n long, text string"


def _short(text: str) -> str:
    """Plain text without its middle, of which only matters whether it is blank."""
    return _PLAIN.sub(lambda m: m[0][:_EDGE] + ("x" if m[0][_EDGE:-_EDGE].strip() else "") + m[0][-_EDGE:], text)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring pieces with their number; a run goes on up to a piece with a closing brace.

    A box closes in such a piece only, so a scanner that reads runs finds the piece in which it does.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.sort_by([("seq_id", "ascending"), ("pos", "ascending")])
        seq, pos, piece = (batch.column(c) for c in ("seq_id", "pos", "piece"))
        piece = piece.fill_null("")
        near = pc.and_(pc.equal(seq[1:], seq[:-1]), pc.equal(pos[1:], pc.add(pos[:-1], 1))).fill_null(False)
        near = pc.and_not(near, pc.match_substring(piece[:-1], "}"))
        first = pc.indices_nonzero(pc.invert(pa.concat_arrays([pa.array([False]), near])))
        starts, texts = [*first.to_pylist(), batch.num_rows], piece.to_pylist()
        runs = list(zip(starts, starts[1:], strict=False))
        columns = [
            seq.take(first),
            pos.fill_null((1 << 63) - 1).take(first),  # last, as a place that is not known
            pa.array([b - a for a, b in runs], pa.int64()),
            pa.array([_short("".join(texts[a:b])) for a, b in runs], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "pos", "n", "text"])


class BoxedStops(StatefulProcessor):
    """Pieces so far of each rollout of a range of ids, and the number of the one in which its first box with content closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scans", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans = {seq: scan for seq, *scan in zip(*(self.state.get() or [[]] * 7), strict=True)}
        runs = pd.concat(list(rows)).sort_values(["seq_id", "pos"], kind="stable")
        out = []
        for seq, own in runs.groupby("seq_id", sort=False, dropna=False):
            seq = None if pd.isna(seq) else int(seq)
            n, done, depth, matched, filled, boxes = scans.get(seq, (0, -1, 0, 0, False, []))
            scan = Scanner(depth, matched, filled, [int(x) for x in boxes])
            for count, text in zip(own["n"].tolist(), own["text"].tolist(), strict=True):
                n += count
                if done < 0 and scan.read(text):
                    done, scan = n, Scanner()
            scans[seq] = (n, done, scan.depth, scan.matched, scan.filled, scan.boxes)
            out.append((seq, n, None if done < 0 else done))
        self.state.update(tuple(map(list, zip(*((seq, *scan) for seq, scan in scans.items()), strict=True))))
        ids, counts, stops = zip(*out, strict=True)
        yield pd.DataFrame({"seq_id": pd.array(ids, "Int64"), "tokens": counts, "stop_at": pd.array(stops, "Int64")})

    def close(self) -> None:
        pass
