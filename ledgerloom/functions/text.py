"""Classification of and extraction from page text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, BARE = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ", "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"


def fold(c: Column) -> Column:
    """Upper case without accents."""
    return F.upper(F.translate(c, ACCENTED, BARE))


# Words that speak for a kind of document, with their weights.
WEIGHTED = {
    "BOLETO": {"FICHA DE COMPENSACAO": 15, "FICHA DE CAIXA": 15, "NOSSO NUMERO": 10, "LINHA DIGITAVEL": 12, "CODIGO DE BARRAS": 10, "SACADO": 8, "CEDENTE": 8, "BENEFICIARIO": 6, "PAGADOR": 6, "VALOR DO DOCUMENTO": 5},
    "NFE": {"DANFE": 15, "NOTA FISCAL ELETRONICA": 15, "NF-E": 10, "CHAVE DE ACESSO": 10, "NCM": 8, "PROTOCOLO DE AUTORIZACAO": 8, "RECEBEMOS DE": 6},
    "NFSE": {"NOTA FISCAL DE SERVICO": 15, "NFS-E": 15, "PREFEITURA MUNICIPAL": 10, "ISS": 8, "PRESTADOR DE SERVICO": 8},
    "COMPROVANTE": {"COMPROVANTE DE PAGAMENTO": 15, "COMPROVANTE PIX": 18, "COMPROVANTE TED": 18, "COMPROVANTE DOC": 18, "PAGO PARA": 15, "PAGAMENTO EFETUADO": 10, "PIX ENVIADO": 12, "TED ENVIADO": 12, "AUTENTICACAO SISBB": 15, "AUTENTICACAO MECANICA": 10, "SOBRE A TRANSACAO": 12, "CHAVE PIX": 10},
    "APOLICE": {"APOLICE": 15, "SEGURO": 8, "SINISTRO": 8, "SEGURADORA": 6},
}
# Words counted for the kind of a page.
COUNTED = {
    "NFE": ["DANFE", "DOCUMENTO AUXILIAR DA NOTA FISCAL", "NF-E", "NFE", "NOTA FISCAL ELETRONICA", "CHAVE DE ACESSO", "PROTOCOLO DE AUTORIZACAO"],
    "NFSE": ["NOTA FISCAL DE SERVICO", "NFS-E", "NFSE", "NOTA FISCAL ELETRONICA DE SERVICOS", "PREFEITURA MUNICIPAL", "IMPOSTO SOBRE SERVICOS", "ISS"],
    "BOLETO": ["LINHA DIGITAVEL", "FICHA DE COMPENSACAO", "AUTENTICACAO MECANICA", "CODIGO DE BARRAS", "SACADO", "CEDENTE", "VENCIMENTO", "ATE O VENCIMENTO", "APOS O VENCIMENTO", "INSTRUCOES"],
    "COMPROVANTE": ["COMPROVANTE DE PAGAMENTO", "COMPROVANTE DE TRANSFERENCIA", "AUTENTICACAO SISBB", "TRANSACAO EFETUADA", "PAGAMENTO EFETUADO", "PAGAMENTO REALIZADO", "RECIBO DE PAGAMENTO", "PIX ENVIADO", "TED ENVIADA", "DOC ENVIADO"],
}
# Ordered rules; the first kind with a word in the text is taken.
ORDERED = [
    ("NFE", ["DANFE", "NOTA FISCAL ELETRONICA", "PROTOCOLO DE AUTORIZACAO DE USO"]),
    ("NFSE", ["NFS-E", "NOTA FISCAL DE SERVICO", "PREFEITURA", "ISSQN", "PRESTADOR", "TOMADOR", "VALOR LIQUIDO"]),
    ("COMPROVANTE", ["COMPROVANTE DE PAGAMENTO", "COMPROVANTE DE TRANSFERENCIA", "COMPROVANTE PIX", "COMPROVANTE TED", "COMPROVANTE DOC", "DEBITO EFETUADO", "PAGAMENTO EFETUADO", "PAGAMENTO REALIZADO", "LIQUIDADO EM", "QUITACAO", "QUITADO", "SISBB", "AUTENTICACAO BANCARIA", "CODIGO AUTENTICACAO"]),
    ("BOLETO", ["RECIBO DO PAGADOR", "AUTENTICACAO MECANICA", "NOSSO NUMERO", "LINHA DIGITAVEL", "VENCIMENTO", "VALOR DO DOCUMENTO"]),
    ("EXTRATO", ["EXTRATO"]),
    ("COMPROVANTE", ["COMPROVANTE"]),
]
# Fixed values, without accents as texts are folded: words of a planned payment.
PLANNED = [
    "AGENDAMENTO", "AGENDADO", "PREVISTO", "DATA PROGRAMADA", "PAGAMENTO PROGRAMADO", "ORDEM FUTURA",
    "PREVISAO DE DEBITO", "AGENDAR PAGAMENTO", "PAGAMENTO AGENDADO PARA", "DATA PREVISTA", "DEBITO FUTURO", "PAGAMENTO SERA EFETUADO", "CONFIRMACAO DE AGENDAMENTO",
    "TRANSFERENCIA AGENDADA", "PIX AGENDADO", "TED AGENDADA", "DOC AGENDADO",
]
# Words of a scheduled payment, and phrases that deny it.
SCHEDULED = ["AGENDAMENTO", "AGENDADO", "AGENDADA", "PREVISTO", "PREVISTA", "PROGRAMADO", "PROGRAMADA", "DATA PROGRAMADA"]
DENIED = ["NAO HOUVE AGENDA", "NAO AGENDADO", "SEM AGENDAMENTO"]
# Words that are counted for a planned and for a made payment.
COUNT_PLANNED = ["AGENDAMENTO", "AGENDADO", "PREVISAO DE DEBITO", "DEBITAR EM", "SOLICITACAO DE", "AUTORIZACAO PENDENTE"]
COUNT_MADE = ["COMPROVANTE", "AUTENTICACAO", "PAGO", "QUITADO", "LIQUIDADO", "DEBITO EFETUADO", "PAGAMENTO REALIZADO"]
# Words that confirm a bank's payment, the bank's authentication, and the mark that counts three.
CONFIRMED = ["PAGAMENTO EFETUADO", "TRANSACAO EFETUADA", "TRANSFERENCIA REALIZADA", "PIX ENVIADO", "TED ENVIADA", "DOC ENVIADO", "DEBITO EFETUADO", "OPERACAO REALIZADA"]
AUTHENTICATION = r"\b([A-Z0-9])\.([A-Z0-9]{3})\.([A-Z0-9]{3})\.([A-Z0-9]{3})\b"
MARK = r"SISBB[=:\s]*[0-9X.]+"


def _any(up: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(up, F.lit(w))
    return out


def _count(up: Column, words: dict[str, int] | list[str]) -> Column:
    w = words if isinstance(words, dict) else dict.fromkeys(words, 1)
    out = F.lit(0)
    for k, v in w.items():
        out = out + F.when(F.contains(up, F.lit(k)), v).otherwise(0)
    return out


def _best(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(kind, score) of the largest score; ties go to the kind listed first; UNKNOWN for 0."""
    top = F.greatest(*scores.values())
    kind = F.when(top == 0, "UNKNOWN")
    for k, v in scores.items():
        kind = kind.when(v == top, k)
    return kind, top


def classify_weighted(text: Column) -> tuple[Column, Column]:
    """(kind, confidence) from weighted words and three rules of precedence; confidence is the score over 50, at most 1."""
    up = fold(F.coalesce(text, F.lit("")))
    s = {k: _count(up, w) for k, w in WEIGHTED.items()}
    slip = s["BOLETO"] + F.when(_any(up, ["LINHA DIGITAVEL", "NOSSO NUMERO"]) & (s["NFE"] < 15), 10).otherwise(0)
    receipt = F.when((slip > 0) & (slip >= s["COMPROVANTE"]), 0).otherwise(s["COMPROVANTE"])
    slip = F.when(F.contains(up, F.lit("DANFE")) & (s["NFE"] >= 15), F.floor(slip / 2).cast("int")).otherwise(slip)
    kind, top = _best(s | {"BOLETO": slip, "COMPROVANTE": receipt})
    return kind, F.least(top / 50.0, F.lit(1.0))


def classify_page(text: Column) -> tuple[Column, Column]:
    """(kind, share of its words found) by counting words."""
    up = fold(F.coalesce(text, F.lit("")))
    s = {k: _count(up, w) for k, w in COUNTED.items()}
    kind, top = _best(s)
    size = F.when(F.lit(False), F.lit(1))
    for k, w in COUNTED.items():
        size = size.when(kind == k, len(w))
    return kind, F.coalesce(top / size, F.lit(0.0))


def classify_ordered(text: Column) -> Column:
    up = fold(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in ORDERED:
        out = out.when(_any(up, words), kind)
    return out.otherwise("UNKNOWN")


def is_planned(text: Column) -> Column:
    """True where a payment is only planned; phrases that deny it win."""
    up = fold(F.coalesce(text, F.lit("")))
    return ~_any(up, DENIED) & _any(up, SCHEDULED)


def payment_state(text: Column) -> tuple[Column, Column, Column, Column]:
    """(state, confidence, words for planned, words for made): planned if those are more, confirmed if any speaks for it, else pending; the bank's mark counts three."""
    up = fold(F.coalesce(text, F.lit("")))
    planned, made = _count(up, COUNT_PLANNED), _count(up, COUNT_MADE) + F.when(up.rlike(MARK), 3).otherwise(0)
    state = F.when(planned > made, "PLANNED").when(made > 0, "CONFIRMED").otherwise("PENDING")
    sure = F.when(planned > made, F.least(F.lit(0.9), 0.6 + planned * 0.1)).when(made > 0, F.least(F.lit(0.95), 0.7 + made * 0.1)).otherwise(0.5)
    return state, F.round(sure, 6), planned, made


def bank_payment(text: Column) -> tuple[Column, Column]:
    """(reason, authentication): planned, confirmed with and without authentication, probable by authentication alone, or nothing said."""
    up = fold(F.coalesce(text, F.lit("")))
    auth = F.nullif(F.regexp_extract(up, AUTHENTICATION, 0), F.lit(""))
    said = _any(up, CONFIRMED)
    reason = F.when(_any(up, PLANNED), "PLANNED").when(said & auth.isNotNull(), "CONFIRMED").when(said, "CONFIRMED_UNSIGNED").when(auth.isNotNull(), "PROBABLE").otherwise("NOTHING")
    return reason, auth


def route_by_length(text: Column, least: int = 200) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least, "DIGITAL_OK").otherwise("NEEDS_OCR")


# Words that speak for readable text.
SANE = ["NOTA", "FISCAL", "NFE", "CNPJ", "VALOR", "EMISSAO", "VENCIMENTO", "PAGADOR"]


def is_junk(text: Column) -> Column:
    """Text too short, with too few letters and figures, or with few and no known word."""
    t = F.trim(F.coalesce(text, F.lit("")))
    share = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.length(t)
    return F.when(F.length(t) < 10, True).when(share < 0.4, True).otherwise((share < 0.6) & ~_any(F.upper(t), SANE))


# Ways of writing a document's number, by kind, in order of rank.
NUMBER = {
    "NFE": [(r"NF-?E\s*N[º°O.]*\s*(\d{3,9})", 0.98), (r"DANFE.{0,60}?N[º°O.]+\s*(\d{3,9})", 0.97)],
    "NFSE": [(r"NFS-?E\s+N[ÚU]MERO\s+(\d{3,9})", 0.98), (r"ELETR[ÔO]NICA\s+N[ÚU]MERO\s+(\d{3,9})", 0.97)],
    "BOLETO": [(r"N[º°O.]*\s*DOCUMENTO\s+(\d{3,9})", 0.98), (r"NF[-\s]?(\d{4,9})", 0.90)],
    "COMPROVANTE": [(r"AUTENTICA[ÇC][ÃA]O\s+(\d{5,12})", 0.95)],
}


def document_number(text: Column, kind: Column) -> tuple[Column, Column]:
    """(number without leading zeros, confidence) by the ranked ways of the row's kind."""
    up = F.upper(F.coalesce(text, F.lit("")))
    number, conf = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for k, forms in NUMBER.items():
        for p, c in forms:
            v = F.regexp_replace(F.regexp_extract(up, p, 1), "^0+", "")
            number, conf = number.when((kind == k) & (F.length(v) >= 3), v), conf.when((kind == k) & (F.length(v) >= 3), c)
    return number, conf.otherwise(0.0)


INSTALLMENT = r"(?:^|\s)(\d{3})\s+(\d{2}/\d{2}/\d{4})\s+([\d.]*\d,\d{2})"


def installments_of(text: Column) -> Column:
    """Array of (seq_num, due_date, amount_cents) from a table of installments."""
    part = lambda k: F.regexp_extract_all(text, F.lit(INSTALLMENT), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(x["a"].cast("int").alias("seq_num"), F.regexp_replace(x["b"], r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1").alias("due_date"), F.regexp_replace(x["c"], r"[.,]", "").cast("bigint").alias("amount_cents")))


def access_key(text: Column) -> Column:
    """The 44 figures of a key printed in groups of four or run together; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"((?:\d{4}\s?){10}\d{4})", 1), r"\s", ""), F.lit(""))


# Words of links to financial documents, hosts to ignore and hosts of banks and tax offices.
LINK_WORDS = [
    "boleto", "nota fiscal", "nfe", "nfse", "fatura", "duplicata", "visualizar", "imprimir", "2ª via", "segunda via", "download", "baixar", "ver documento", "acessar",
    "clique aqui", "abrir", "gerar pdf", "emitir", "danfe", "dacte", "guia", "pagamento", "invoice", "receipt", "payment", "bill", "view", "print", "open document", "click here", "access",
]
LINK_PATTERN = "|".join(LINK_WORDS)
LINK_IGNORED = ["facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "whatsapp.com", "telegram.org", "mailto:", "tel:", "javascript:", "#", "unsubscribe", "privacy", "terms", "help.", "support.", "google.com/analytics", "doubleclick.net", "googleadservices.com"]
LINK_KNOWN = ["itau", "bradesco", "santander", "bb.com.br", "caixa.gov.br", "sicoob", "sicredi", "nubank", "inter.co", "safra", "banrisul", "nfe.", "nfse.", "sefaz", "prefeitura", "gov.br", "totvs", "senior", "sap.", "linx", "sydle"]


def link_confidence(url: Column, label: Column) -> Column:
    """0 to 1: words in the label and the address, a PDF, a known host; 0 for ignored addresses."""
    u = F.lower(url)
    hits = lambda c: F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(LINK_PATTERN))
    s = F.least(hits(label) * 0.15, F.lit(0.5)) + F.least(hits(url) * 0.10, F.lit(0.3)) + F.when(F.contains(u, F.lit(".pdf")), 0.3).otherwise(0.0) + F.when(_any(u, LINK_KNOWN), 0.25).otherwise(0.0)
    return F.when(u.isNull() | _any(u, LINK_IGNORED), 0.0).otherwise(F.least(s, F.lit(1.0)))


def json_answer(text: Column, schema: str) -> Column:
    """Struct read from the outermost braces of a text, fences around it ignored; null where unreadable."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def labelled_dates(text: Column) -> tuple[Column, Column, Column]:
    """(due, emission, payment) as printed after their labels; null where there is none."""
    up = F.upper(text)
    get = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    day = r"([0-9]{2}/[0-9]{2}/[0-9]{4})"
    return get(rf"VENCIMENTO[:\s]*{day}"), get(rf"EMISS[ÃA]O[:\s]*{day}"), get(rf"(?:PAGO EM|PAGAMENTO EM)\s+{day}")
