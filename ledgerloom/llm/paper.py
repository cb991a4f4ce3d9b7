"""What is printed on a scanned paper, read in spite of reading errors."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Labels printed before a value, by kind of value.
LABELS = {
    "due": ["vencimento "],
    "made": ["data do processamento ", "emissao ", "data de emissao: ", "data de emissao "],
    "number": ["no documento ", "nota fiscal de servicos eletronica numero ", "nfs-e numero ", "nf-e no ", "danfe no ", "danfe - documento auxiliar da nota fiscal eletronica no "],
    "amount": ["(=) valor do documento r$ ", "valor total da nota r$ ", "valor liquido r$ "],
    "paid": ["pago em "],
    "total": ["total pago r$ "],
    "auth": ["autenticacao "],
    "part": ["parcela "],
    "chave": ["chave "],
    "day": ["data "],
    "estimate": ["estimativa "],
    "ORCAMENTO": ["orcamento "],
    "ROMANEIO": ["romaneio "],
    "ORDEM": ["ordem de servico "],
    "RELATORIO": ["relatorio de entrega "],
    "DECLARACAO": ["declaracao "],
}
#: Titles of papers that are known by nothing else.
TITLES = ("ORCAMENTO", "ROMANEIO", "ORDEM", "RELATORIO", "DECLARACAO")
#: Kind of paper that a label or an opening word speaks for.
KINDS = {"due": "BOLETO", "paid": "COMPROVANTE", "total": "COMPROVANTE", "auth": "COMPROVANTE", "chave": "NFE", "part": "BOLETO"}
ISSUER = {"emitente": "NFE", "beneficiario": "BOLETO", "favorecido": "COMPROVANTE", "prestador": "NFSE"}
OPENERS = {"danfe": "NFE", "nf-e": "NFE", "nfs-e": "NFSE", "nota fiscal de servicos": "NFSE", "comprovante": "COMPROVANTE", "recibo de pagamento": "COMPROVANTE", "comprovante pix": "COMPROVANTE", "valor total da nota": "NFE", "valor liquido": "NFSE", "data do processamento": "BOLETO", "servico: transporte": "NFSE"}
#: Letters read for figures.
FIGURES = str.maketrans("OoDQIlíi|SsBZzGg", "0000111115582299")
BREAK = re.compile(r"[\r\n]+")
FIRST = re.compile(r"[0-9]")
DATE = re.compile(r"([0-9OolIíSsBZ]{1,2}) ?/ ?([0-9OolIíSsBZ]{1,2}) ?/ ?([0-9OolIíSsBZ]{3,4})")
MONEY = re.compile(r"[0-9OolIíSsBZ][0-9OolIíSsBZ., ]*[.,] ?[0-9OolIíSsBZ]{1,2}(?![0-9])")
RUN = re.compile(r"[0-9OolIíSsBZ]+")
PARTS = re.compile(r"([0-9OolIíSsBZ]{1,2}) ?/ ?([0-9OolIíSsBZ]{1,2})(?![0-9/])")
INLINE = re.compile(r" (?=(?:vencim|data d|n\S{0,2} {1,2}\S{0,2}ocu\S+ \d|\(=\)|valor total|valor liq|emiss|pa\S?o em|total pago|aut\S?nti\S+ \d|benef|emitente|favorec|prestador|chave \d))")


def plain(s: str) -> str:
    """Lower case without accents, width and raised letters; characters without an ASCII base are left out."""
    s = s.lower()
    return s if s.isascii() else unicodedata.normalize("NFKD", s.replace("°", "o")).encode("ascii", "ignore").decode()


def near(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


_FORMS = [(kind, f, frozenset(f), 1 if len(f) < 9 else 2 if len(f) < 14 else 4) for kind, forms in LABELS.items() for f in forms]
_EXACT = {f: kind for kind, f, _, _ in _FORMS}
#: No text longer than this is within the edits allowed of a label; no opener is decided by more letters than this.
LONGEST = max(len(f) + most for _, f, _, most in _FORMS)
LONGEST_OPENER = max(map(len, OPENERS))


@lru_cache(400_000)
def label_of(head: str) -> str | None:
    """Kind of value announced by the text before a line's first figure."""
    if head in _EXACT:
        return _EXACT[head]
    best, letters, n = None, frozenset(head), len(head)
    for kind, f, own, most in _FORMS:
        # an edit changes the length by one and the sets of letters by two at most
        if -most <= len(f) - n <= most and len(letters ^ own) <= 2 * most:
            d = near(head, f, most)
            if d <= most and (best is None or d < best[0]):
                best = (d, kind)
    return best and best[1]


@lru_cache(200_000)
def issuer_word(word: str) -> str | None:
    w = word.rstrip(":")
    if w in ISSUER:
        return w
    hits = [k for k in ISSUER if len(set(w) ^ set(k)) <= 4 and near(w, k, 2) <= 2]
    return hits[0] if len(hits) == 1 else None


@lru_cache(400_000)
def opener_kind(head: str) -> str | None:
    """Kind of paper whose opening words begin ``head``, up to one wrong letter in the longer ones."""
    for k, v in OPENERS.items():
        if head.startswith(k):
            return v
        # with one edit the first letters agree, or the second letter of either is the first or second of the other
        if len(k) > 5 and head and (head[0] == k[0] or head[1:2] in k[:2] or head[0] == k[1]) and len(set(head[: len(k)]) ^ set(k)) <= 2 and near(head[: len(k)], k, 1) <= 1:
            return v
    return None




def digits(s: str) -> str:
    return re.sub(r"\D", "", s.translate(FIGURES))


def read_paper(text: str | None) -> dict[str, str | None]:
    """kind, number, part, due, made, amount, auth, access key and issuer printed on a text.

    A field that is missing or unreadable is None.  Lines are recognised by their
    labels up to a few wrong letters; letters read for figures count as figures.
    """
    out: dict[str, str | None] = dict.fromkeys(("kind", "number", "part", "due", "made", "amount", "auth", "chave", "issuer"))
    if not text or not text.strip():
        return out
    votes = dict.fromkeys(("NFE", "NFSE", "BOLETO", "COMPROVANTE"), 0)
    other: dict[str, str | None] = {}
    # a line may hold several labels
    flat = INLINE.sub("\n", plain(text))
    lines = []
    for row in BREAK.split(flat):
        cells = [c for c in row.split("  ") if c]
        # two blanks part the lines of some scans, but may also be a reading error within a line
        lines += [c.strip() for c in cells]
        if len(cells) > 1:
            lines += [f"{a.strip()} {b.strip()}" for a, b in zip(cells, cells[1:]) if len(a) <= LONGEST and not FIRST.search(a)]
    lines = [x for x in lines if x]
    if not lines:
        return out
    # a line may break between a label and its value
    lines += [f"{a} {b}" for a, b in zip(lines, lines[1:]) if (b[0] in "0123456789" or b[:2] == "r$") and len(a) <= LONGEST and not FIRST.search(a)]
    for line in lines:
        m = FIRST.search(line)
        head = line[: m.start()] if m else line
        opens = opener_kind(head[:LONGEST_OPENER])
        if opens:
            votes[opens] += 1
        kind = label_of(head) if m and len(head) <= LONGEST else None
        if kind:
            tail = line[m.start() :]
            if kind in KINDS:
                votes[KINDS[kind]] += 1
            if kind in ("due", "made"):
                d = DATE.match(tail)
                if d and not out[kind]:
                    out[kind] = digits(d[0])
            elif kind == "day":
                d = DATE.match(tail)
                other.setdefault("made", digits(d[0]) if d else None)
            elif kind == "estimate":
                a = MONEY.match(tail)
                other.setdefault("amount", digits(a[0]) if a else None)
            elif kind in TITLES and "kind" not in other:
                n = RUN.match(tail)
                other |= {"kind": kind, "number": digits(n[0]).lstrip("0") if n else None}
            elif kind == "paid":
                d = DATE.match(tail)
                if d and not out["made"]:
                    out["made"] = digits(d[0])
                a = MONEY.search(tail, 8)
                if a and not out["amount"]:
                    out["amount"] = digits(a[0])
            elif kind == "total":
                a = MONEY.match(tail)
                d = DATE.search(tail)
                out["amount"] = out["amount"] or (digits(a[0]) if a else None)
                out["made"] = out["made"] or (digits(d[0]) if d else None)
            elif kind == "amount":
                a = MONEY.match(tail)
                out["amount"] = out["amount"] or (digits(a[0]) if a else None)
            elif kind == "number":
                n = RUN.match(tail)
                out["number"] = out["number"] or (digits(n[0]).lstrip("0") if n else None)
                if "arcela" in tail or "parc" in tail:
                    p = PARTS.search(tail, n.end())
                    out["part"] = out["part"] or (p and f"{int(digits(p[1]) or 0)}")
            elif kind == "part":
                p = PARTS.match(tail)
                out["part"] = out["part"] or (p and f"{int(digits(p[1]) or 0)}")
            elif kind == "auth":
                n = RUN.match(tail)
                out["auth"] = out["auth"] or (digits(n[0]).lstrip("0") if n else None)
            elif kind == "chave":
                k = digits(tail)
                if len(k) == 44:
                    out["chave"] = k
        word, _, rest = line.partition(" ")
        w = issuer_word(word) if rest else None
        if w:
            votes[ISSUER[w]] += 1
            if not out["issuer"]:
                out["issuer"] = re.sub(r"[^a-z0-9]+", " ", rest.split(" cnpj")[0]).strip() or None
    best = max(votes.values())
    if best:
        out["kind"] = next(k for k, v in votes.items() if v == best)
    elif "kind" in other:
        out |= other
    return out


NUMBER_COL = re.compile(r"\d[\d.]*")


def read_number(raw: str | None) -> tuple[str | None, str | None]:
    """(number, installment) of a freely typed document number, e.g. 'NF 71770 PARC 6', '71770 2/6', '071770/5', '64.148'."""
    if not raw or not raw.strip():
        return None, None
    s = plain(raw).strip()
    m = re.search(r"(\d[\d.]*)\s*parc\D*(\d+)", s)
    if m:
        return m[1].replace(".", "").lstrip("0") or None, str(int(m[2]))
    m = re.search(r"(\d[\d.]*\d)\s+(\d{1,2})/(\d{1,2})$", s)
    if m:
        return m[1].replace(".", "").lstrip("0") or None, str(int(m[2]))
    m = re.search(r"(\d{4,})[-/.](\d{1,2}|u)$", s)
    if m:
        return m[1].lstrip("0") or None, None if m[2] == "u" else str(int(m[2]))
    m = NUMBER_COL.search(s)
    return (m[0].replace(".", "").lstrip("0") or None, None) if m else (None, None)


def kind_of_number(raw: str | None) -> str | None:
    """Kind of paper that the way of writing its number speaks for, if any."""
    s = plain(raw or "").strip()
    return "NFE" if s.startswith("nf-e") else "COMPROVANTE" if s.startswith("aut") else "BOLETO" if "parc" in s else None
