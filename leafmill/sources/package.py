"""Office packages: parts of a ZIP, their XML, and relationships between them. Standard library only."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from leafmill.schema import ReadError

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class Package:
    """A ZIP of parts, by paths without a leading slash."""

    def __init__(self, content: bytes, what: str):
        self.what = what
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ReadError("CorruptFile", f"not a readable {what}: {e}") from None
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def events(self, name: str) -> Iterator[tuple[str, ElementTree.Element]]:
        """Starts and ends of a part's elements, in order; what has ended is forgotten by its parent once that ends too."""
        try:
            for what, e in ElementTree.iterparse(io.BytesIO(self.plain(name)), ("start", "end")):
                yield what, e
                if what == "end":
                    for child in e:
                        child.clear()
        except ElementTree.ParseError as e:
            raise ReadError("CorruptFile", f"{self.what} part {name} is missing or invalid: {e}") from None

    def xml(self, name: str) -> ElementTree.Element:
        """A part's root."""
        try:
            return ElementTree.fromstring(self.plain(name))
        except ElementTree.ParseError as e:
            raise ReadError("CorruptFile", f"{self.what} part {name} is missing or invalid: {e}") from None

    def plain(self, name: str) -> bytes:
        """A part's bytes. Documents with a DTD are refused: they could define entities."""
        data = self.read(name)
        if data is None:
            raise ReadError("CorruptFile", f"{self.what} part {name} is missing or invalid: it is not in the file")
        if b"<!DOCTYPE" in data:
            raise ReadError("CorruptFile", f"{self.what} part {name} is missing or invalid: it has a document type")
        return data

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """Of each relationship to another part: its id, that part's path, and the last word of the relationship's type."""
        folder, base = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{base}.rels")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels).iter(f"{PACKAGE}Relationship"):
            if r.get("TargetMode") != "External":
                to = r.get("Target", "")
                out[r.get("Id", "")] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to)), r.get("Type", "").rpartition("/")[2]
        return out

    def main(self, usual: str) -> str:
        """The part that the package is about."""
        return next((path for path, kind in self.related("").values() if kind == "officeDocument"), usual)
