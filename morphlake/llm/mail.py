"""What a reader sees of a mail message: its text parts, decoded."""

from __future__ import annotations

import binascii
import html
import re

_SPLIT = re.compile(r"\r?\n\r?\n")
_FIELD = re.compile(r"(?im)^(content-type|content-transfer-encoding)[ \t]*:[ \t]*([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)")
_PARAM = re.compile(r"(?is)\b(boundary|charset)[ \t]*=[ \t]*(?:\"([^\"]*)\"|([^\s;\"]+))")
_BREAK = re.compile(r"(?i)<(?:br|/?p|/?div|/?li|/?tr|/?h[1-6]|/?ul|/?ol|/?table|/?blockquote|hr)\b[^>]*>")
_HIDDEN = re.compile(r"(?is)<(script|style|head)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_DELIMITER = re.compile(r"(?m)^--([^\r\n]*?)[ \t]*\r?(?:\n|\Z)")
#: Quote marks at the start of a line.
QUOTE = re.compile(r"(?m)^(?:[ \t]*[>|])+[ \t]*")


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        plain = _NOT_BASE64.sub("", body)
        raw = binascii.a2b_base64(plain[: len(plain) - (len(plain) % 4 == 1)] + "=" * (-len(plain) % 4)) if plain else b""
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def visible(markup: str) -> str:
    """The text of HTML: blocks and breaks end lines, other tags vanish, references are resolved."""
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", markup))))


def _pieces(body: str, boundary: str) -> list[str]:
    """What stands after each line of a boundary, up to the next or the end."""
    lines = [m for m in _DELIMITER.finditer(body) if m[1] == boundary or m[1] == f"{boundary}--"]
    return [body[m.end() : n] for m, n in zip(lines, [*(m.start() for m in lines[1:]), len(body)])]


def text_parts(message: str) -> list[str]:
    """The text parts and text attachments of a message, decoded and without markup, however deep they lie.

    Cut-off multiparts give what is there; parts of other types than text give nothing. A message without an
    empty line is all headers and gives nothing, except for a part without headers.
    """
    out, todo = [], [(message, False)]
    while todo:
        text, is_part = todo.pop()
        if is_part and text.startswith(("\n", "\r\n")):
            head, body = "", text
        else:
            m = _SPLIT.search(text)
            if not m:
                continue
            head, body = text[: m.start()], text[m.end() :]
        kind, encoding, params = "text/plain", "", {}
        for name, value in _FIELD.findall(head):
            if name.lower() == "content-type":
                kind = value.split(";")[0].strip().lower() or "text/plain"
                params = {k.lower(): a or b for k, a, b in _PARAM.findall(value)}
            else:
                encoding = value.strip().lower()
        if kind.startswith("multipart/") and params.get("boundary"):
            todo += [(piece, True) for piece in reversed(_pieces(body, params["boundary"].rstrip(" \t")))]
        elif kind == "message/rfc822":
            todo.append((_decoded(body, encoding, params.get("charset", "")), True))
        elif kind.startswith("text/"):
            body = _decoded(body, encoding, params.get("charset", ""))
            out.append(visible(body) if kind == "text/html" else body)
    return out


def unquoted(text: str) -> str:
    """text without quote marks at line starts."""
    return QUOTE.sub("", text)
