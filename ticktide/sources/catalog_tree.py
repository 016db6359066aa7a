"""Catalogue trees of JSON nodes: walking by path over alternate places, and fragments of a node."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator


class NoNode(LookupError):
    """No node of that path."""


def fragment(doc, path: str):
    """The part of a JSON value at a/b/0: keys and list positions between slashes; None where it ends before."""
    for key in [x for x in path.strip("/#").split("/") if x]:
        if isinstance(doc, dict) and key in doc:
            doc = doc[key]
        elif isinstance(doc, list) and key.lstrip("-").isdigit() and -len(doc) <= int(key) < len(doc):
            doc = doc[int(key)]
        else:
            return None
    return doc


class Node:
    """A catalogue node: its document, path and where it came from."""

    def __init__(self, doc: dict, path: str, url: str, fetch: Callable[[str], str]):
        self.doc, self.path, self.url, self.fetch = doc, path, url, fetch

    @property
    def kind(self) -> str:
        return self.doc.get("type", "")

    @property
    def children(self) -> dict[str, dict]:
        found = self.doc.get("catalog") or {}
        return {k.lower(): v for k, v in found.items()} if isinstance(found, dict) else {}

    def child(self, name: str) -> Node:
        """A direct child; each of its URLs is tried until one gives a node."""
        entry = self.children.get(name.lower())
        if entry is None:
            raise NoNode(f"{self.path} has no {name!r}")
        urls = entry.get("urls") or entry.get("URLS") or []
        path = f"{self.path}/{name.lower()}".strip("/")
        for url in urls:
            try:
                return Node(json.loads(self.fetch(url)), path, url, self.fetch)
            except (OSError, ValueError, KeyError):
                continue
        raise NoNode(f"no place of {path!r} could be read")

    def walk(self, path: str) -> Node:
        """The node of a path below this one; a child's name may itself hold slashes, the longest that leads on wins."""
        rest = path.strip("/").lower()
        if not rest:
            return self
        for name in sorted(self.children, key=len, reverse=True):
            if rest == name or rest.startswith(name + "/"):
                try:
                    return self.child(name).walk(rest[len(name) :])
                except NoNode:
                    continue
        raise NoNode(f"no {path!r} under {self.path or 'the root'}")

    def get(self, path: str):
        return fragment(self.doc, path)

    def text(self, part: str = "") -> str:
        """The node, or a fragment of it, as indented JSON."""
        return json.dumps(self.get(part) if part else self.doc, indent=2, ensure_ascii=False)

    def tree(self, depth: int = 10) -> Iterator[tuple[str, str, str]]:
        """(path, type, title) of this node and those below; nodes that can't be read are left out, and no place is read twice."""
        stack, seen = [(self, 0)], set()
        while stack:
            node, level = stack.pop()
            if node.url in seen:
                continue
            seen.add(node.url)
            yield node.path, node.kind, str(node.doc.get("title", ""))
            for name in reversed(list(node.children) if level < depth else []):
                try:
                    stack.append((node.child(name), level + 1))
                except NoNode:
                    continue


def from_files(root: str) -> Node:
    """A catalogue of local files: URLs are paths below root, with or without file://."""
    import os

    base = os.path.realpath(root)

    def fetch(url: str) -> str:
        p = os.path.realpath(os.path.join(base, url.removeprefix("file://").lstrip("/") if not url.startswith("file:///") else url.removeprefix("file://")))
        if not p.startswith(base + os.sep):
            raise OSError(f"{url} lies outside of the catalogue")
        with open(p, encoding="utf-8") as f:
            return f.read()

    return Node(json.loads(fetch("index.json")), "", "index.json", fetch)


def rows(spark, node: Node, depth: int = 10):
    """path, type and title of a tree as a frame."""
    return spark.createDataFrame(list(node.tree(depth)), "path string, type string, title string")


def from_network(url: str):
    """Reading by HTTP or from sockets isn't offered: fetch files first, then read them."""
    raise NotImplementedError(f"{url}: network sources aren't supported; read files instead")
