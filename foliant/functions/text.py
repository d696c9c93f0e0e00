"""Hidden text, its zones, outlines and link annotations, from decoded payloads."""

from __future__ import annotations

from dataclasses import dataclass

#: Zone types by code.
ZONES = {1: "page", 2: "column", 3: "region", 4: "para", 5: "line", 6: "word", 7: "char"}
STACKED, BESIDE = (1, 4, 5), (2, 6, 7)
SHAPES = ("rect", "oval", "text", "poly", "line")
#: Hardening of our own: nesting that zones, outlines and annotations may have.
DEPTH = 64


class Cursor:
    """Bounded big-endian reads; a read past the end raises EOFError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def biased(self) -> int:
        return self.uint(2) - 0x8000


@dataclass
class Zone:
    zone_id: int
    parent_id: int | None
    depth: int
    ordinal: int
    type: int
    x: int
    y: int
    w: int
    h: int
    start: int
    length: int
    text: str | None = None


def text_bytes(payload: bytes | None) -> bytes | None:
    """The text of a payload, clamped to what is there; None under three bytes."""
    if payload is None or len(payload) < 3:
        return None
    return payload[3 : 3 + int.from_bytes(payload[:3], "big")]


def zones(payload: bytes | None, page_height: int | None) -> list[Zone]:
    """The zone tree in preorder, boxes from the top; empty if any record fails.

    Each record is placed by the zone before it: by its parent's if it is a first child, else by
    its elder sibling's, below or beside according to the type.
    """
    text = text_bytes(payload)
    if text is None:
        return []
    cursor, out = Cursor(payload, 3 + len(text)), []
    try:
        cursor.take(1)  # version
        # open zones: (zone, children still to come, last child)
        stack: list[list] = []
        while True:
            kind = cursor.uint(1)
            x, y, w, h, offset = (cursor.biased() for _ in range(5))
            length, children = cursor.uint(3), cursor.uint(3)
            parent, ordinal = None, 0
            if stack:
                parent, _, elder, ordinal = stack[-1]
                if elder is None:
                    x, y, offset = x + parent.x, parent.y + parent.h - y - h, offset + parent.start
                else:
                    if elder.type in STACKED:
                        x, y = x + elder.x, elder.y - y - h
                    elif elder.type in BESIDE:
                        x, y = x + elder.x + elder.w, y + elder.y
                    offset += elder.start + elder.length
            zone = Zone(len(out), parent.zone_id if parent else None, len(stack), ordinal, kind, x, y, w, h, offset, length)
            out.append(zone)
            if stack:
                stack[-1][1:] = stack[-1][1] - 1, zone, ordinal + 1
            if children:
                if len(stack) >= DEPTH or children * 17 > len(payload):
                    return []
                stack.append([zone, children, None, 0])
            while stack and not stack[-1][1]:
                stack.pop()
            if not stack:
                break
    except EOFError:
        return []
    height = out[0].y + out[0].h if page_height is None else page_height
    for z in out:
        z.y = height - z.y - z.h
        a = min(max(z.start, 0), len(text))
        z.text = text[a : max(a, min(z.start + z.length, len(text)))].decode("utf-8", "replace")
    return out


@dataclass
class Bookmark:
    node_id: int
    parent_id: int | None
    depth: int
    ordinal: int
    title: str
    url: str


def outline(payload: bytes | None) -> list[Bookmark]:
    """Nodes in preorder. A top-level entry that breaks off is dropped whole; those before it stay."""
    if payload is None or len(payload) < 2:
        return []
    cursor = Cursor(payload)
    total, out, top = cursor.uint(2), [], 0
    while len(out) < total and cursor.at < len(payload):
        own: list[Bookmark] = []
        stack: list[list[int]] = []  # [node, children to come, next ordinal]
        try:
            while True:
                children = cursor.uint(1)
                title, url = (cursor.take(cursor.uint(3)).decode("utf-8", "replace") for _ in range(2))
                node = Bookmark(len(out) + len(own), stack[-1][0] if stack else None, len(stack), stack[-1][2] if stack else top, title, url)
                own.append(node)
                if stack:
                    stack[-1][1] -= 1
                    stack[-1][2] += 1
                if children:
                    if len(stack) >= DEPTH:
                        raise EOFError
                    stack.append([node.node_id, children, 0])
                while stack and not stack[-1][1]:
                    stack.pop()
                if not stack:
                    break
        except EOFError:
            break
        out += own
        top += 1
    return out


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "b": "\b"}


def expressions(source: str) -> list:
    """Lists and atoms (quoted or not) of an annotation; what is not closed ends with the source."""
    root: list = []
    stack, i = [root], 0
    while i < len(source):
        c = source[i]
        if c.isspace():
            i += 1
        elif c == "(":
            if len(stack) > DEPTH:
                return root
            stack[-1].append(inner := [])
            stack.append(inner)
            i += 1
        elif c == ")":
            if len(stack) > 1:
                stack.pop()
            i += 1
        elif c == '"':
            i, atom = i + 1, []
            while i < len(source) and source[i] != '"':
                if source[i] == "\\" and i + 1 < len(source):
                    i += 1
                    atom.append(ESCAPES.get(source[i], source[i]))
                else:
                    atom.append(source[i])
                i += 1
            stack[-1].append("".join(atom))
            i += 1
        else:
            j = i
            while j < len(source) and not source[j].isspace() and source[j] not in '()"':
                j += 1
            stack[-1].append(source[i:j])
            i = j
    return root


def leading_int(atom) -> int:
    """The number that an atom begins with, else 0."""
    if isinstance(atom, list):
        return 0
    s = atom.strip()
    n = 1 if s[:1] in ("+", "-") else 0
    while n < len(s) and s[n].isdigit() and s[n].isascii():
        n += 1
    try:
        return int(s[:n])
    except ValueError:
        return 0


@dataclass
class Link:
    url: str
    comment: str | None
    shape: str
    x: int
    y: int
    w: int
    h: int


def links(source: str | None, page_height: int) -> list[Link]:
    """All hyperlink areas of an annotation, however deep, in order."""
    found: list[Link] = []

    def area(items: list) -> None:
        target, comment, shape = None, None, None
        for item in items:
            if shape is None and isinstance(item, list) and item and item[0] in SHAPES:
                shape = item
            elif target is None:
                target = item
            elif comment is None and isinstance(item, str):
                comment = item
        if isinstance(target, list):
            target = target[1] if len(target) > 1 and target[0] == "url" and isinstance(target[1], str) else None
        if target and shape and shape[0] in SHAPES[:3] and len(shape) >= 5:
            x, y, w, h = map(leading_int, shape[1:5])
            found.append(Link(target, comment or None, shape[0], x, page_height - y - h, w, h))

    waiting = [expressions(source or "")]
    while waiting:
        items = waiting.pop()
        if items and items[0] == "maparea":
            area(items[1:])
        waiting.extend(x for x in reversed(items) if isinstance(x, list))
    return found
