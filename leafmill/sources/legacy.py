"""Binary Office files: LibreOffice turns them into their successors where it is installed."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

from leafmill.schema import ReadError

# What each becomes, and how long a conversion may take.
SUCCESSOR = {"doc": "docx", "xls": "xlsx", "ppt": "pptx"}
SECONDS = 180


def converted(content: bytes, kind: str) -> tuple[bytes, str, str]:
    """The converted file, its format and a warning. The scratch folder is the worker's own and goes at once."""
    to = SUCCESSOR[kind]
    office = shutil.which("soffice") or shutil.which("soffice.exe")
    if office is None:
        raise ReadError("UnsupportedFormat", f"unsupported: .{kind} is a legacy binary format and needs LibreOffice (soffice was not found on PATH); convert the file to .{to} or install LibreOffice")
    with tempfile.TemporaryDirectory() as scratch:
        source = Path(scratch, f"file.{kind}")
        source.write_bytes(content)
        try:
            subprocess.run([office, "--headless", "--convert-to", to, "--outdir", scratch, str(source)], check=True, capture_output=True, timeout=SECONDS)
        except (subprocess.SubprocessError, OSError) as e:
            raise ReadError("CorruptFile", f"LibreOffice could not convert the file: {e}") from None
        out = source.with_suffix(f".{to}")
        if not out.is_file():
            raise ReadError("CorruptFile", f"LibreOffice produced no {to} for the file")
        return out.read_bytes(), to, f"converted .{kind} to {to} with LibreOffice before reading"
