"""A plain version of the page extractor: whole paths on every block, sums anew at every step; for pages whose tags all end."""

import html as entities
import re

from vidlake.llm.html_text import BLOCK, CLOSES_P, CONTAINER, NEAR, RAW, SHORT, VOID, _noisy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "text", "links", "kind")

    def __init__(self, path, text, links, kind):
        self.path, self.text, self.links, self.kind = path, text, links, kind


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order, with the generalised path of their open containers; boilerplate left out.

    Unclosed tags stay open until an ancestor closes; a stray end tag is skipped.
    """
    page = page or ""
    # tag, classes, dropped, and for a boilerplate name the blocks before it (else -1)
    stack: list[tuple[str, str, bool, int]] = []
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    kind = ""

    def flush() -> None:
        nonlocal links, kind
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(tuple(f"{t}.{c}" if c else t for t, c, *_ in stack if t in CONTAINER), text, links, kind))
        parts.clear()
        links, kind = 0, ""

    def add(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1][2]):
            text = entities.unescape(raw)
            parts.append(text)
            if any(t == "a" for t, *_ in stack):
                links += len(text)

    def close(k: int) -> None:
        """Close the tags from the k-th on; those named like boilerplate lose what is short or mostly links."""
        if any(start >= 0 for *_, start in stack[k:]):
            flush()
        while len(stack) > k:
            start = stack.pop()[3]
            if start >= 0:
                chars = sum(len(b.text) for b in out[start:])
                if chars < SHORT or 2 * sum(b.links for b in out[start:]) >= chars:
                    del out[start:]

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found.group(1) is not None:
            add(found.group(1))
            continue
        name = found.group(3)
        if name is None:
            continue
        tag = name.lower()
        if found.group(2):
            if any(t == tag for t, *_ in stack):
                if tag in BLOCK:
                    flush()
                close(max(k for k, e in enumerate(stack) if e[0] == tag))
            elif tag in BLOCK and not (stack and stack[-1][2]):
                flush()
            continue
        attrs = found.group(4) or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                # an open paragraph ends here, and the inline tags left open in it
                last = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), None)
                if last is not None and stack[last][0] == "p":
                    close(last)
            elif tag in ("li", "dd", "dt", "td", "th", "tr"):
                last = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK - {"p"}), None)
                if last is not None and (stack[last][0] == tag or {stack[last][0], tag} <= {"dd", "dt"} or {stack[last][0], tag} <= {"td", "th"}):
                    close(last)
        if tag in VOID:
            continue
        bad, named, classes = _noisy(tag, attrs, any(t in ("article", "main") for t, *_ in stack))
        if not attrs.endswith("/") or tag in BLOCK:
            stack.append((tag, classes, bad or bool(stack and stack[-1][2]), len(out) if named else -1))
            if tag in BLOCK:
                kind = tag
    flush()
    close(0)
    return out


def _weight(block: Block) -> float:
    return max(0, len(block.text) - 2 * block.links) * (1.0 if block.kind in ("p", "pre", "blockquote", "h1", "h2", "h3") else 0.5)


def best_container(found: list[Block]) -> tuple[str, float]:
    """The path of the container with the most paragraph text of its own, widened; ('', 0) for none.

    A block counts whole for its nearest container and half for the one above.
    """
    scores: dict[tuple[str, ...], float] = {}
    for block in found:
        weight = _weight(block)
        for depth in range(min(2, len(block.path))):
            path = block.path[: len(block.path) - depth]
            scores[path] = scores.get(path, 0.0) + weight / (1 << depth)
    path, score = max(scores.items(), key=lambda x: x[1], default=((), 0.0))
    return "/".join(_widened(found, path) if score > 0 else path), score


def _widened(found: list[Block], path: tuple[str, ...]) -> tuple[str, ...]:
    """The outermost article or main around ``path``, else its farthest ancestor below the body, as long as each step adds a block that is not mostly links."""
    tops = [k for k, t in enumerate(path, 1) if t.split(".")[0] in ("article", "main")]
    steps = [k for k in tops[::-1] if k < len(path)] if tops else [k for k in range(len(path) - 1, 0, -1) if path[k - 1].split(".")[0] != "body"]
    for k in steps:
        added = [b for b in found if b.path[:k] == path[:k] and b.path[: len(path)] != path]
        if any(len(b.text) > 2 * b.links for b in added):
            path = path[:k]
        elif added:
            break
    return path


def under(found: list[Block], path: str) -> list[Block]:
    return [b for b in found if (p := "/".join(b.path)) == path or p.startswith(path + "/")]


def text_under(found: list[Block], path: str) -> str:
    return "\n".join(b.text for b in under(found, path))


def chosen_path(found: list[Block], winner: str | None) -> str:
    """The winner where it holds the page's own best container or near as much; else the page's own, the wider of both if one holds the other."""
    own, score = best_container(found)
    mine = under(found, winner) if winner else []
    if not mine or score <= 0:
        return winner if mine else own
    if own == winner or winner.startswith(own + "/"):
        return own
    if own.startswith(winner + "/") or sum(map(_weight, mine)) >= NEAR * sum(map(_weight, under(found, own))):
        return winner
    return own


def extract(page: str | None, winner: str | None) -> str:
    found = blocks(page)
    text = text_under(found, path) if (path := chosen_path(found, winner)) else ""
    return text or "\n".join(b.text for b in found)
