"""Text of documents: encodings, and the XML inside office containers. Python on executors, in Arrow batches."""

from __future__ import annotations

import io
import re
import time
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFF_BYTES = 8192
MEMBER_BYTES = 32 << 20
ENTITY_BYTES = 10

#: Extensions of office containers and the members that hold their text.
MEMBERS = {
    "docx": r"word/document\.xml",
    "docm": r"word/document\.xml",
    "xlsx": r"xl/sharedStrings\.xml",
    "xlsm": r"xl/sharedStrings\.xml",
    "pptx": r"ppt/slides/slide(\d+)\.xml",
    "pptm": r"ppt/slides/slide(\d+)\.xml",
    "odt": r"content\.xml",
    "ods": r"content\.xml",
    "odp": r"content\.xml",
}
#: The named entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_text(data: bytes) -> str | None:
    """By byte-order mark, else UTF-8 with replacement; None where a zero byte in the first part says binary."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            body = data[2:]
            return body[: len(body) // 2 * 2].decode(name, "replace")
    return None if b"\0" in data[:SNIFF_BYTES] else data.decode("utf-8", "replace")


def decode_entities(text: str) -> str:
    """The five named entities and numeric ones; anything else stays as it is."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body in ENTITIES:
            return ENTITIES[body]
        try:
            code = int(body[2:], 16) if body[1:2] in "xX" else int(body[1:]) if body[1:].isdigit() else -1
            return chr(code) if body[0] == "#" and code >= 0 and not 0xD800 <= code < 0xE000 else m[0]
        except (ValueError, OverflowError):
            return m[0]

    return re.sub(r"&(#?[0-9A-Za-z]{1,%d});" % ENTITY_BYTES, one, text)


def strip_xml(text: str) -> str:
    """Tags vanish without a separator; CDATA is taken as it is; an unterminated one is literal."""
    out, at = [], 0
    for m in re.finditer(r"<!\[CDATA\[(.*?)\]\]>|<(?!!\[CDATA\[)[^>]*>", text, re.S):
        out.append(decode_entities(text[at : m.start()]))
        out.append(m[1] or "")
        at = m.end()
    return "".join([*out, decode_entities(text[at:])])


def office_text(data: bytes, extension: str) -> str | None:
    """Text of an office container; None where it's broken, encrypted, lacks the member or has no text."""
    pattern = re.compile(MEMBERS[extension.lower()])
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = [(m, name) for name in z.namelist() if (m := pattern.fullmatch(name))]
            found.sort(key=lambda x: int(x[0][1]) if pattern.groups else 0)
            parts = []
            for _, name in found:
                with z.open(name) as f:
                    parts.append(strip_xml(f.read(MEMBER_BYTES).decode("utf-8", "replace")))
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, ValueError, EOFError):
        return None
    return "".join(parts) or None


def extract_text(content: Column, extension: Column, deadline: float | None = None) -> Column:
    """struct<status, text>: status is text, binary, error (null content or a broken container), or not_scanned after the
    deadline (seconds since the epoch), which is looked at before each row, so that a scan ends with what it has."""

    @F.pandas_udf("status string, text string")
    def run(contents: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        rows = []
        for data, ext in zip(contents, extensions, strict=True):
            if deadline is not None and time.time() > deadline:
                rows.append(("not_scanned", None))
            elif data is None:
                rows.append(("error", None))
            elif (ext or "").lower() in MEMBERS:
                text = office_text(bytes(data), ext)
                rows.append(("error" if text is None else "text", text))
            else:
                text = decode_text(bytes(data))
                rows.append(("binary" if text is None else "text", text))
        return pd.DataFrame(rows, columns=["status", "text"])

    return run(content, extension)
