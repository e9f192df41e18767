"""The sender's own words of a raw e-mail: MIME decoding, and the removal of quotes, signatures and footers.

Tolerant by design: missing closing boundaries, broken base64, unknown charsets and texts without a header all give
the best text that is there. Both line endings are read. The result of a null or blank text is the empty string.
"""

from __future__ import annotations

import base64
import binascii
import html
import re

#: Parts within parts are read down to here; deeper ones count as text.
DEPTH = 200
_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:")
_TYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)([^\n]*)", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*([^;\s]*)", re.I | re.M)
_ATTACHED = re.compile(r"^content-disposition:[ \t]*attachment", re.I | re.M)
_BOUNDARY = re.compile(r"boundary=(?:\"([^\"]*)\"|([^;\s]+))", re.I)
_CHARSET = re.compile(r"charset=\"?([^\";\s]+)", re.I)
_FOLD = re.compile(r"\n[ \t]+")
_QP = re.compile(rb"=([0-9A-Fa-f]{2})|=[ \t]*\n")
# No tag reaches over the start of another, and what is never closed ends with the text: each of these is linear.
_DROPPED = re.compile(r"<(style|script|head|blockquote)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"<(?:br|/p|/div|/li|/tr|/h\d|hr)\b[^<>]*>\n?", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!?/?[a-z][^<>]*>", re.I | re.S)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(</title\s*>|\Z)", re.I | re.S)
#: A line that starts an unmarked quotation of everything below it.
_CUT = re.compile(r"^\s*-{3,} ?(?=[^-\n]*(?:original|forward|message|mail\b|nachricht|weitergeleitet|ursprünglich|transféré|mensaje|reenviado|messaggio|inoltrato|mensagem|encaminhada))[^-\n]{3,60}? ?-{3,}\s*$", re.I)
_DATED = re.compile(r"[\d@]")
_QUOTED = re.compile(r"^\s*(?:[>|]|&gt;)")
_SIGNATURE = re.compile(r"^-- ?$")
_FOOTER = re.compile(r"^(?:_{5,}|={5,}|\*{5,}|-{20,})\s*$")
#: What the lines below a divider say if it starts the footer of a list.
_LIST = re.compile(r"mailing.?list|listinfo|list-|unsubscribe|to leave, write|you get this because|you (?:are|were) (?:receiving|subscribed)|abmelden|mailingliste|désabonner|liste de diffusion|darse de baja|lista de (?:correo|distribución|discussão)|@lists\.|options: ", re.I)
#: What a notice to the addressee says besides its opening.
_DISCLAIMS = re.compile(r"confiden[tc]ial|confidentiel|vertraulich|riservat|privileged|addressee|intended (?:only )?(?:for|recipient)|recipient|destinat|empfänger|irrläufer|legally|liab|haftung|in error\b|viruse?s?\b", re.I)
#: How notices to the addressee begin, in the languages of mail programs.
NOTICES = ("This message and its attachments", "This e-mail", "This email", "The information in this", "Diese Nachricht", "Diese E-Mail", "Ce message", "Este mensaje", "Esta mensagem", "Questo messaggio")


def says(line: str) -> bool:
    """Whether a line introduces marked lines: it ends in a colon and holds a date or an address."""
    bare = line.rstrip()
    return bare.endswith(":") and bool(_DATED.search(bare))


def _decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        data = re.sub(r"[^A-Za-z0-9+/]", "", body)
        data = data[: len(data) - (len(data) % 4 == 1)]
        try:
            raw = base64.b64decode(data + "=" * (-len(data) % 4))
        except binascii.Error:
            return body
    elif encoding == "quoted-printable":
        raw = _QP.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else b"", body.encode("utf-8"))
    else:
        return body
    for name in (charset, "utf-8"):
        try:
            return raw.decode(name or "utf-8").replace("\r\n", "\n")
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("latin-1").replace("\r\n", "\n")


def leaves(entity: str, depth: int = 0) -> list[tuple[str, str]]:
    """(type, text) of the text parts that aren't attachments; ``entity`` has plain line ends."""
    head, body = "", entity
    if _HEADER.match(entity):
        head, _, body = entity.partition("\n\n")
    elif depth and entity.startswith("\n"):
        body = entity[1:]
    head = _FOLD.sub(" ", head)
    kind = _TYPE.search(head)
    mime, params = (kind[1].lower(), kind[2]) if kind else ("text/plain", "")
    if mime.startswith("multipart/") and depth < DEPTH:
        mark = _BOUNDARY.search(params)
        if mark:
            parts = re.split(rf"(?:^|\n)--{re.escape(mark[1] or mark[2])}(--)?[ \t]*(?:\n|\Z)", body)
            found: list[tuple[str, str]] = []
            for k in range(2, len(parts), 2):
                if parts[k - 1] == "--":
                    break
                found += leaves(parts[k], depth + 1)
            if found or len(parts) > 1:
                return [found[0]] if mime == "multipart/alternative" and found and found[0][1].strip() else found
    if _ATTACHED.search(head) or not (mime.startswith("text/") or mime.startswith("multipart/") or not mime):
        return []
    encoding = _ENCODING.search(head)
    charset = _CHARSET.search(params)
    return [(mime, _decode(body, encoding[1].lower() if encoding else "", charset[1] if charset else ""))]


def plain(markup: str) -> str:
    """The visible text of HTML without what it quotes; a page's title comes first."""
    title = _TITLE.search(markup)
    text = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("", markup)))
    return html.unescape((title[1] + "\n" if title and title[2] else "") + text)


def own(text: str | None) -> str:
    """What the sender wrote: no quoted mail, signature block, list footer or notice to the addressee."""
    if not text or text.isspace():
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kept: list[str] = []
    for mime, part in leaves(text):
        lines = (plain(part) if mime == "text/html" else part).split("\n")
        quoted = [bool(_QUOTED.match(x)) for x in lines]
        out: list[str] = []
        skipped = 0
        for k, line in enumerate(lines):
            if quoted[k] or k < skipped:
                continue
            if _CUT.match(line) or _SIGNATURE.match(line):
                break
            if _FOOTER.match(line) and k:
                below = [x for x in lines[k + 1 : k + 8] if x.strip()]
                if not below or _LIST.search("\n".join(below[:3])):
                    break
                continue
            if line.startswith(NOTICES):
                end = next((j for j in range(k, len(lines)) if not lines[j].strip()), len(lines))
                if _DISCLAIMS.search(" ".join(lines[k:end])):
                    skipped = end
                    continue
            follows = next((j for j in range(k + 1, min(k + 4, len(lines))) if lines[j].strip()), None)
            if follows is not None and quoted[follows] and (says(line) or says(line + " " + lines[k + 1])):
                continue
            out.append(line)
        kept.append("\n".join(out).strip())
    return "\n\n".join(x for x in kept if x)
