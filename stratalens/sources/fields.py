"""Where a byte stands in structured text, byte by byte, and which number is likely to follow.

A tracker is fed the bytes of a stream in order, so an encoder and a decoder see the same. It keeps the
field, the bytes since the last token border, whether the place is inside a string, and a second axis
(column or depth). Integer fields are predicted by ``last + delta`` or from a column to the left.
"""

from __future__ import annotations

import re

#: The last place in a token that is told apart, columns with a model across columns, the cap of a
#: counter, open XML elements, and the depth of SQL parentheses.
PLACES, COLUMNS, CAP, MOST_OPEN, MOST_DEEP = 31, 32, 255, 64, 32
INTEGER = re.compile(rb"-?[0-9]{1,18}\Z")


class Numbers:
    """Histories of integer fields, and offsets between the columns of a row."""

    def __init__(self):
        self.known: dict = {}  # field: [last, delta, hits]
        self.across: dict[int, list[int]] = {}  # column: [source, offset, hits]
        self.row: dict[int, int] = {}

    def predict(self, field, column: int | None) -> tuple[bytes, int]:
        """The digits that are expected, and how often the hypothesis has held."""
        own = self.known.get(field)
        if column is not None and (x := self.across.get(column)) and x[2] >= 2 and x[0] in self.row and (own is None or x[2] > own[2]):
            return b"%d" % (self.row[x[0]] + x[1]), x[2]
        return (b"%d" % (own[0] + own[1]), own[2]) if own else (b"", 0)

    def learn(self, field, column: int | None, v: int) -> None:
        own = self.known.get(field)
        if own is None:
            self.known[field] = [v, 0, 0]
        else:
            own[2] = min(own[2] + 1, CAP) if own[0] + own[1] == v else own[2] // 2
            own[1], own[0] = v - own[0], v
        if column is None or column >= COLUMNS:
            return
        x = self.across.setdefault(column, [-1, 0, 0])
        if x[2] >= 1 and x[0] in self.row and self.row[x[0]] + x[1] == v:
            x[2] = min(x[2] + 1, CAP)
        elif (same := next((c for c in range(column) if self.row.get(c) == v), None)) is not None:
            x[:] = [same, 0, 1]
        elif column - 1 in self.row:
            x[:] = [column - 1, v - self.row[column - 1], 1]
        else:
            x[2] //= 2
        self.row[column] = v


class Tracker:
    """Plain text: blanks end a token outside quotes, and an opening quote begins one."""

    def __init__(self):
        self.field, self.place, self.quoted, self.axis = b"", 0, False, 0
        self.numbers, self.token, self.numeric = Numbers(), bytearray(), False
        self.expected, self.count = b"", 0

    def push(self, c: int) -> None:
        opens = c == 34 and not self.quoted
        if c == 34:
            self.quoted = not self.quoted
        self.place = 0 if opens or (c in b" \t\r\n" and not self.quoted) else min(self.place + 1, PLACES)

    def start(self, field, column: int | None = None) -> None:
        """A value of a field may begin with the next byte."""
        self.field, self.place, self.numeric, self.column = field, 0, True, column
        self.token.clear()
        self.expected, self.count = self.numbers.predict(field, column)

    def take(self, c: int) -> None:
        """A byte of a value: digits go on, anything else ends the number."""
        if not self.numeric:
            return
        if 48 <= c <= 57 or (c == 45 and not self.token):
            self.token.append(c)
            return
        if c not in b".eE" and INTEGER.match(self.token):
            self.numbers.learn(self.field, self.column, int(self.token))
        self.numeric, self.expected = False, b""

    def digit(self) -> int | None:
        """The byte that the prediction expects next."""
        n = len(self.token)
        return self.expected[n] if self.numeric and n < len(self.expected) and self.expected.startswith(self.token) else None


class Csv(Tracker):
    def __init__(self):
        super().__init__()
        self.start(0, 0)

    def push(self, c: int) -> None:
        if c == 34:
            self.quoted = not self.quoted
        if c in b",\n" and not self.quoted:
            self.take(c)
            self.axis = 0 if c == 10 else self.axis + 1
            if c == 10:
                self.numbers.row.clear()
            self.start(self.axis, self.axis)
        else:
            self.take(c)
            self.place = min(self.place + 1, PLACES)


class Json(Tracker):
    def __init__(self):
        super().__init__()
        self.frames: list[list] = []  # [is an object, last key, awaits a key]
        self.escaped = self.in_key = self.open = False

    def _field(self):
        return b"" if not self.frames else self.frames[-1][1] if self.frames[-1][0] else b"[]"

    def push(self, c: int) -> None:
        self.place = min(self.place + 1, PLACES)
        if self.quoted:
            if self.escaped or c not in b'"\\':
                self.escaped = False
                if self.in_key:
                    self.frames[-1][1] += bytes([c])
            elif c == 92:
                self.escaped = True
            else:
                self.quoted = self.in_key = False
            return
        if self.open and c in b" \t\r\n":
            return
        self.take(c)
        self.open = False
        top = self.frames[-1] if self.frames else None
        if c == 34:
            self.quoted, self.place = True, 0
            if top and top[0] and top[2]:
                self.in_key, top[1], top[2] = True, b"", False
        elif c in b"{[":
            self.frames.append([c == 123, b"", c == 123])
        elif c in b"}]" and top:
            self.frames.pop()
        self.axis = len(self.frames)
        if c == 58 or c == 91 or (c == 44 and not (top and top[0])):
            self.open = True
            self.start(self._field())
        elif c == 44:
            top[2], self.place = True, 0


class Sql(Tracker):
    def __init__(self):
        super().__init__()
        self.columns: list[int] = []
        self.escaped = self.open = False

    def push(self, c: int) -> None:
        self.place = min(self.place + 1, PLACES)
        if self.quoted:
            if self.escaped or c not in b"'\\":
                self.escaped = False
            elif c == 92:
                self.escaped = True
            else:
                self.quoted = False
            return
        if self.open and c in b" \t\r\n":
            return
        self.take(c)
        self.open = False
        if c == 39:
            self.quoted, self.place = True, 0
        elif c == 40:
            if not self.columns:
                self.numbers.row.clear()
            self.columns.append(0)
        elif c == 41 and self.columns:
            self.columns.pop()
        elif c == 44 and self.columns:
            self.columns[-1] += 1
        self.axis = self.columns[-1] if self.columns else 0
        if c in b"(," and self.columns:
            self.open, depth = True, min(len(self.columns), MOST_DEEP)
            self.start((depth, self.axis), self.axis if depth == 1 else None)


class Xml(Tracker):
    def __init__(self):
        super().__init__()
        self.stack: list[bytes] = []
        self.state, self.name, self.quote, self.alone = "text", bytearray(), 0, False

    def push(self, c: int) -> None:
        self.place = min(self.place + 1, PLACES)
        if self.state == "text":
            if c == 60:
                self.state, self.alone, self.place = "name", False, 0
                self.name.clear()
        elif self.state == "value":
            if c == self.quote:
                self.state = "tag"
        elif c == 62:
            closing = self.name.startswith(b"/")
            if closing:
                self.stack[-1:] = []
            elif not self.alone and len(self.stack) < MOST_OPEN:
                self.stack.append(bytes(self.name))
            self.state, self.place = "text", 0
        elif c in b"\"'":
            self.state, self.quote, self.place = "value", c, 0
        elif self.state == "name" and c not in b" \t\r\n" and (c != 47 or not self.name):
            self.name.append(c)
        else:
            self.alone |= c == 47 and not self.name.startswith(b"/")
            self.state = "tag"
        self.quoted, self.axis = self.state == "value", len(self.stack)
        self.field = (self.stack[-1] if self.stack else b"", self.state)


TRACKERS = {"generic": Tracker, "csv": Csv, "json": Json, "sql": Sql, "xml": Xml}
