"""Labelled training lines for the personal-data tagger.

Every line is assembled from pieces, so its spans are known exactly; reading
errors, upper case and joined lines are applied afterwards while the spans are
carried along.  Nothing here comes from a person: surnames are made of
syllables.  The grammar trains the model; of its lists the operator itself uses
those of given names and their short forms, to drop names found without any given
name, and the words for lines of business, to drop companies (see ``pii.py``).
Streets, banks, farms and hosts are fixed lists of the domain, so the accuracy on
held-out lines of the grammar says nothing about streets or hosts unlike these.
"""

from __future__ import annotations

import random

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]

# Given names and short forms used in training lines.
GIVEN = """Alexandre Antônio Antonio Aparecida Beatriz Catarina Cláudio Claudio Daniel Eduardo Fernando
Francisco Gabriela Geraldo Helena Isabel Joaquim José Jose Leonardo Luiz Margarida Maria Norberto Otávio
Otavio Patrícia Patricia Raimundo Roberto Sebastião Sebastiao Terezinha Ulisses Vicente Wanda Ana João Pedro
Paulo Carlos Marcos Lucas Mateus Rafael Bruno Marcelo Rodrigo Gustavo Sandra Juliana Camila Vera Rosa Lúcia
Sônia Célia Marta Silvia Regina Fátima Adriana Luciana Renata Débora Simone Mário Sérgio Jorge Manoel""".split()
NICK = """Xande Toninho Tonho Cida Bia Cacá Claudinho Dani Dudu Edu Nando Chico Gabi Gegê Lena Bel Quim Zé Zeca
Kiko Bibi Fe Catita Cati Cau Nardo Cente Quinzinho Nobinho Otavinho Tícia Ticia Vivi Ale Tete Tica Juca Toco Rô Mila Mª Norbe Bastião Mundinho Leninha Cidinha Léo Lu Guida Mariazinha Beto Betinho Nonô Tavinho Pati Raí Tião Tetê Tereza Uli Vicentinho Wandinha""".split()
CATEGORY = """Sementes|Fertilizantes|Pneus|Tratores|Transportes|Comércio de Peças|Lubrificantes|Veterinária|
Implementos Agrícolas|Materiais de Construção|Energia|Telecomunicações|Contabilidade|Seguros|Refrigeração|
Irrigação|Embalagens|Distribuidora|Laticínios|Ferragens|Auto Posto|Posto|Nutrição Animal|Agropecuária|
Serviços Mecânicos|Insumos|Armazéns Gerais|Máquinas|Indústria e Comércio|Sem.|Fertil.|Pn.|Trat.|Transp.|Lubrif.|
Vet.|Impl. Agr.|Mat. Const.|Ener.|Telecom|Contab.|Seg.|Refrig.|Embal.|Distrib.|Ferr.|Nutr. Animal|Agrop.|
Serv. Mec.|Máq.|Ind. Com.""".replace("\n", "").split("|")
SUFFIX = ["Ltda", "Ltda.", "LTDA", "ME", "EPP", "EIRELI", "S/A", "S.A.", "& Cia Ltda", "Ltda - ME", "", "", ""]
ONSET = "b br c cr cl d dr f fl fr g gr j l m n p pl pr r s t tr v vr z bl".split()
STREET = """das Perdizes|do Engenho Torto|dos Tropeiros Mansos|da Lagoa Turva|do Carro de Boi|das Mangabeiras|
das Jabuticabas|do Pau Terra|dos Ipês Roxos|Sete Porteiras|Quinze Léguas|das Flores|do Comércio|da Matriz""".replace("\n", "").split("|")
GOODS = """cimento CP II|herbicida|rolamento 6205|sal mineral 30 kg|correia dentada|lona preta|pneu 18.4-34|frete|
vacina aftosa|parafuso sextavado|bateria 150 Ah|calcário dolomítico|semente de soja|óleo diesel S10|válvula|
honorários|bomba submersa|adubo 04-14-08|mão de obra|graxa de lítio|filtro de ar|telha de fibrocimento|
disco de arado|mangueira hidráulica|retentor|ração bovina|arame liso""".replace("\n", "").split("|")
DOMAINS = """campo.example grupo-sul.example example.net example.com example.org fiscal.example cobranca.test
notas.example contas.invalid mail.rural.example br.example""".split()
BANKS = ["Cooperativa Credilago", "Banco do Vale Turvo", "Banco Três Porteiras S.A.", "Caixa Agrícola Serrana"]


class Lines:
    """Source of labelled lines; the same seed gives the same lines."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    # pieces ---------------------------------------------------------------
    def num(self, shape: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "9" else c for c in shape)

    def surname(self) -> str:
        r = self.r
        n = r.choice([1, 2, 2, 2, 3, 3])
        out = ""
        for k in range(n):
            out += r.choice(ONSET) + r.choice("aeiou") + r.choice(["", "", "", "n", "r", "l", "m"] if k < n - 1 else ["", "", "z", "l", "r", "m", "s", "n"])
        if n == 1:
            out += r.choice(["des", "ge", "les", "bra", "gi", "so"])
        return out.capitalize()

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJLMNOPRSTUVWZ")

    def name(self, supplier: bool = False) -> str:
        r = self.r
        g = r.choice(GIVEN) if r.random() < (0.85 if supplier else 0.98) else r.choice(NICK)
        s = self.surname
        u = r.random()
        if supplier:
            a, b = s(), s()
            n = (f"{g} {a} {b}" if u < 0.5 else f"{g} {a} {b[0]}." if u < 0.58 else f"{g[0]}. {a} {b}" if u < 0.66 else f"{a} {b} {g}" if u < 0.74 else f"{a} {b}, {g}" if u < 0.82
                 else f"{g} {a}" if u < 0.86 else f"{g[0]}. {a} {b[0]}." if u < 0.89 else f"{g} de {a} {b}" if u < 0.93 else f"{g[0]} {r.choice(['de', 'da'])} {a} {b}" if u < 0.95 else f"{a} {b[0]}., {g}" if u < 0.97 else f"{a}, {g}")
        else:
            n = (f"{g} {s()}" if u < 0.3 else f"{g} {s()} {s()}" if u < 0.52 else f"{g} {r.choice(['de', 'da', 'dos', 'do'])} {s()} {s()}" if u < 0.68 else f"{g} {self.initial()}. {s()}" if u < 0.78
                 else f"{g[0]}. {s()}" if u < 0.85 else f"{g} {r.choice(GIVEN)} {s()}" if u < 0.94 else f"{s()}, {g}")
        u = r.random()
        return n.upper() if u < 0.3 else n.lower() if u < (0.36 if supplier else 0.33) else n

    def company(self) -> str:
        r = self.r
        a, b = self.surname(), self.surname()
        if r.random() < 0.1:
            a = r.choice(GIVEN) if r.random() < 0.3 else a
        c, x = r.choice(CATEGORY), r.choice(SUFFIX)
        u = r.random()
        core = (f"{a} {b} {c}" if u < 0.4 else f"{c} {a} {b}" if u < 0.75 else f"{a} {b[0]}. {c}" if u < 0.8 else f"{b} {a} {c}" if u < 0.83 else f"{c} {a} {b[0]}." if u < 0.86
                else f"{a} {c}" if u < 0.89 else f"{a}{b.lower()} {c}" if u < 0.91 else f"{c} {a}{b.lower()}" if u < 0.93 else f"{a} {b}" if u < 0.97 else f"{a} {b[0]}.")
        n = f"{core} {x}".strip()
        if r.random() < 0.1:
            n += r.choice([" - FILIAL 02", " (MATRIZ)", " FIL. NORTE", " UN. 3", " - ME", " filial 2"])
        u = r.random()
        return n.upper() if u < 0.42 else n.lower() if u < 0.5 else n

    def email(self) -> str:
        r = self.r
        role = r.choice(["contas.pagar", "vendas", "nf", "financeiro"])
        sep = r.choice(["", ".", "-", "_"])
        plain = lambda x: x.lower().translate(str.maketrans("áâãàéêíóôõúç", "aaaaeeiooouc"))
        u = r.random()
        local = role if u < 0.2 else f"{role}{sep}{self.surname()}" if u < 0.6 else f"{r.choice(GIVEN)}{sep}{self.surname()}" if u < 0.85 else f"{self.surname()}{sep}{self.surname()}"
        local = plain(local) + (self.num("99") if r.random() < 0.3 else "") + ("+nfe" if r.random() < 0.06 else "")
        d = r.choice(DOMAINS)
        if r.random() < 0.15:
            d = f"{plain(self.surname())}.{d.split('.')[-1]}"
        u = r.random()
        e = f"{local}@{d}" if u < 0.66 else f"{local} @ {d}" if u < 0.76 else f"{local}(at){d}" if u < 0.84 else f"{local} [arroba] {d.replace('.', ' [ponto] ')}" if u < 0.94 else f"{local} (arroba) {d}" if u < 0.97 else f"{local}[at]{d}"
        return e.upper() if r.random() < 0.15 else e

    def phone(self) -> str:
        r = self.r
        d = r.choice("20 21 23 25 26 29 30 36 39 50 52 53 56 57 58 59 70 72 76 78 11 31 62 65".split())
        mobile = r.random() < 0.5
        pre = r.choice([f"({d}) ", f"({d}) ", f"({d})", f"{d} ", f"{d} ", f"{d}-", d, f"+55 {d} ", f"+55{d}", f"0xx{d} "])
        if pre.endswith("-"):
            body = "99999-9999" if mobile else "9999-9999"
        elif pre == d or pre.startswith("+55") and " " not in pre:
            body = "999999999" if mobile else "99999999"
        elif pre.startswith("0xx"):
            body = "99999.9999" if mobile else "9999.9999"
        elif mobile:
            body = r.choice(["99999-9999", "99999-9999", "99999 9999", "9 9999 9999", "999999999", "9 9999-9999"])
        else:
            body = r.choice(["9999-9999", "9999-9999", "9999 9999", "99 99 9999", "99999999"])
        return pre + self.num(body)

    def cpf(self) -> str:
        return self.num(self.r.choice(["999.999.999-99"] * 5 + ["999999999-99", "999 999 999 99", "99999999999", "99999999999"]))

    def rg(self) -> str:
        return self.num(self.r.choice(["9.999.999", "9999999", "9999999-9", "9999999-X", "XX-99.999.999", "99.999.999-9"]))

    def ident(self) -> tuple[str, str]:
        """(label with its blank, number)"""
        r = self.r
        u = r.random()
        if u < 0.6:
            return r.choice(["CPF ", "CPF: ", "cpf/mf ", "C.P.F. nº ", "CPF do pagador: ", "CPF nº "]), self.cpf()
        if u < 0.82:
            return r.choice(["RG ", "RG nº ", "R.G. ", "Identidade: ", "RG: "]), self.rg()
        if u < 0.91:
            return r.choice(["CNH ", "CNH nº ", "CNH: ", "Habilitação: ", "habilitação: "]), self.num("99999999999")
        return r.choice(["PIS ", "NIS: ", "PIS/PASEP ", "PIS: "]), self.num(r.choice(["999.99999.99-9", "99999999999"]))

    def address(self) -> str:
        r = self.r
        u = r.random()
        street = r.choice(STREET) if u < 0.4 else self.surname() if u < 0.75 else f"{r.choice(GIVEN)} {self.surname()}"
        kind = r.random()
        if kind < 0.12:
            a = f"Rod. X{r.choice('ABGMT')}-{self.num('999')}, Km {r.randrange(1, 500)}, Zona Rural"
            if r.random() < 0.2:
                a = a.replace("Rod. ", "Rodovia ")
        elif kind < 0.27:
            a = f"{r.choice(['Estrada Vicinal', 'Estrada Vicinal', 'Estr.'])} {street}, Km {r.randrange(1, 60)}"
        else:
            t = r.choice(["Rua", "Rua", "R.", "Av.", "Av.", "Av", "Avenida", "Alameda", "Al.", "Travessa", "Trav."])
            a = f"{t} {street}" + r.choice([f", {r.randrange(10, 5000)}", f", {r.randrange(10, 5000)}", " S/N", f" nº {r.randrange(10, 5000)} Qd. {r.randrange(1, 99)} Lt. {r.randrange(1, 50)}"])
        if r.random() < 0.72:
            city = self.surname() + r.choice(["", "", "ndia", " do Norte", " d'Oeste"])
            uf = "X" + r.choice("ABGMT")
            a += r.choice([f", {r.choice(['Bairro', 'Setor', 'Jd.', 'Vila'])} {self.surname()}, {city}/{uf}", f" - {city} - {uf}, CEP {self.num('99999-999')}", f" - {city}/{uf}"])
        return a.upper() if r.random() < 0.22 else a

    def money(self) -> str:
        return self.num(self.r.choice(["99,99", "999,99", "9.999,99", "99.999,99"]))

    def date(self) -> str:
        return self.num("99/99/20") + self.num("99")

    # lines ----------------------------------------------------------------
    def personal(self) -> list:
        r, N = self.r, "NAME"
        name = lambda: (self.name(), N)
        phone = lambda: (self.phone(), "PHONE")
        mail = lambda: (self.email(), "EMAIL")
        addr = lambda: (self.address(), "ADDRESS")
        label, number = self.ident()
        idn = (number, "ID_NUMBER")
        cpf = lambda: (self.cpf(), "ID_NUMBER")
        forms = [
            lambda: ["Att. " + r.choice(["", "Sr. ", "Sra. ", "Dr. ", "Dra. "]), name()],
            lambda: ["A/C ", name()],
            lambda: ["conferido - ", name()],
            lambda: ["Resp. técnico ", name(), f" reg. {self.num('99999')}"],
            lambda: ["Sacado ", name(), ", " + label, idn],
            lambda: ["Sacado ", name(), ", ", cpf()],
            lambda: ["Sacado ", name()],
            lambda: ["Motorista: ", name(), f" placa XYZ{self.num('9999')}"],
            lambda: ["Vendedor(a) ", name(), f" cod {self.num('999')}"],
            lambda: ["falar com ", name(), " no contas a pagar"],
            lambda: ["mercadoria retirada por ", name(), " no balcão"],
            lambda: ["Recebi de ", name(), " a importância acima"],
            lambda: [name(), " pediu segunda via"],
            lambda: ["Testemunha ", name(), " (", cpf(), ")"],
            lambda: ["Pagador: ", name()],
            lambda: ["Ass.: ", name()],
            lambda: ["RECIBO a ", name(), "|", cpf(), "|", phone(), "|", mail()],
            lambda: ["Contato: ", name(), " - ", phone()],
            lambda: ["WhatsApp:", phone(), ";SAC:", phone(), ";", mail()],
            lambda: ["Contatos ", phone(), " / ", phone()],
            lambda: ["Fone: ", phone()],
            lambda: ["Tel/Zap ", phone()],
            lambda: ["ligar ", phone(), " até 17h"],
            lambda: [phone(), " (recado)"],
            lambda: [phone()],
            lambda: [name(), " " + label, idn, ", residente em ", addr(), ", tel. ", phone()],
            lambda: ["Obs: deixar c/ ", name(), ", ", addr()],
            lambda: ["Cliente desde 2019 - ", addr(), " - ", name()],
            lambda: ["End. cobrança ", addr(), " fone ", phone()],
            lambda: ["Entregar em ", addr()],
            lambda: ["Endereço: ", addr()],
            lambda: [addr()],
            lambda: [addr()],
            lambda: ["E-mail: ", mail()],
            lambda: ["enviar XML p/ ", mail()],
            lambda: ["2a via com ", mail(), "; ", mail()],
            lambda: ["2a via com ", mail()],
            lambda: [mail()],
            lambda: ["dep. em nome de ", name(), f" dia {self.date()}, avisar <", mail(), ">"],
            lambda: ["Documento do comprador ", (r.choice([self.cpf, self.cpf, self.rg, lambda: self.num("999.99999.99-9")])(), "ID_NUMBER")],
            lambda: [label, idn],
            lambda: [name(), f" - {r.choice(GOODS)} - {r.choice(GOODS)}"],
            lambda: [r.choice(["Emitente: ", "Emitente: ", "Beneficiário ", "Beneficiário ", "Favorecido: ", "Prestador ", "Emitente "]), (self.name(True), N), r.choice(["", "", "", " (SITIO)", " - MEI", " ME", " ME"])],
            lambda: [r.choice(["Emitente: ", "Emitente: ", "Beneficiário ", "Beneficiário ", "Favorecido: ", "Prestador "]), (self.name(True), N)],
            lambda: [r.choice(["Emitente: ", "Beneficiário ", "Favorecido: "]), (self.name(True), N)],
            lambda: [(self.name(True), N)],
            lambda: [(self.name(True), N), f" - {r.choice(GOODS)} - {r.choice(GOODS)}"],
            lambda: [(self.name(True), N), f"  R$ {self.money()}"],
            lambda: [name()],
        ]
        return r.choice(forms)()

    def other(self) -> list:
        r = self.r
        forms = [
            lambda: r.choice(["Emitente: ", "Emitente: ", "Beneficiário ", "Beneficiário ", "Favorecido: ", "Prestador "]) + self.company(),
            lambda: r.choice(["Emitente: ", "Beneficiário ", "Favorecido: "]) + self.company() + f"  CNPJ {self.num('99.999.999/9999-99')}",
            lambda: self.company(),
            lambda: f"{self.company()} - {r.choice(GOODS)} - {r.choice(GOODS)}",
            lambda: f"{r.randrange(1, 60)} x {r.choice(GOODS)} {self.money()}",
            lambda: f"{self.num('999')} {self.date()} {self.money()}",
            lambda: r.choice(["Emissão ", "Data de emissão: ", "Data do processamento ", "Vencimento ", "Digitalizado em "]) + self.date(),
            lambda: f"(=) Valor do documento R$ {self.money()}",
            lambda: f"VALOR TOTAL DA NOTA R$ {self.money()}",
            lambda: f"Nº documento {self.num(r.choice(['99999', '9999999']))}" + r.choice(["", f"  parcela {r.randrange(1, 9)}/{r.randrange(1, 12)}", f" parcela {r.randrange(1, 9)}/{r.randrange(1, 12)}"]),
            lambda: f"Pedido nº {self.num('9999-9999')}",
            lambda: f"Contrato {self.num('99 99999 9999')}",
            lambda: f"Série {self.num('999')} caixa {self.num('99999999999')}",
            lambda: f"Nosso número {self.num('99/999999999-9')}",
            lambda: f"Volume {self.num('99')} peso {self.num('999')} kg",
            lambda: f"Cód. barras {self.num('99999.99999 99999.999999 9')}",
            lambda: f"Ag. {self.num('9999-9')} C/C {self.num('99999-9')}",
            lambda: f"www.segundavia.example/boleto?id={self.num('999999999')}",
            lambda: f"Lote do produto {self.num('999.999.999')}",
            lambda: f"@ do boi gordo R$ {self.money()}",
            lambda: r.choice(["Documento sem valor fiscal", "Após o vencimento multa de 2% e juros de 1% a.m.", "Recibo do Pagador", "BOLETO", "COMPROVANTE DE PAGAMENTO", "RECIBO DE PAGAMENTO DE TÍTULO", "Página 1 de 1", "2ª via", "cópia", "Enc: fwd", "-- enviado do celular", "lido por leitor óptico"]),
            lambda: f"Ref. Fazenda {r.choice(['Boa Espera', 'Lagoa Turva', 'Três Porteiras'])} safra {self.num('99/99')}",
            lambda: f"Safra da Fazenda {r.choice(['Santa', 'São', ''])} {r.choice(GIVEN)}".replace("  ", " "),
            lambda: f"Retirar na Transportadora {r.choice(GIVEN)} {self.surname()} Ltda",
            lambda: f"Venc. @ {self.num('99')} dias",
            lambda: f"Não receber após {self.num('99')} dias",
            lambda: f"Protocolo de autorização {self.num('999999999999999')}",
            lambda: f"Autenticação {self.num(r.choice(['9999999', '99999999', '999999999']))}",
            lambda: f"Insc. Estadual {self.num('99.999.999-9')}",
            lambda: f"CNPJ {self.num('99.999.999/9999-99')}",
            lambda: f"NCM {self.num('99999999')} CFOP 5102 CST 060",
            lambda: f"ICMS {self.money()} IPI 0,00",
            lambda: f"Chave {self.num('9999 9999 9999 9999 9999 9999 9999 9999 9999 9999 9999')}",
            lambda: r.choice([f"DANFE nº {self.num('99999')} série 1", f"NF-e nº {self.num('9999999')} série 1", f"NFS-e número {self.num('9999999')}", f"DANFE - Documento Auxiliar da Nota Fiscal Eletrônica nº {self.num('99999')} série 1", f"Nota Fiscal de Serviços Eletrônica número {self.num('9999999')}"]),
            lambda: f"Pago em {self.date()} valor R$ {self.money()}",
            lambda: f"Total pago R$ {self.money()} em {self.date()}",
            lambda: f"Serviço: transporte de {r.choice(GOODS)}",
            lambda: f"Valor líquido R$ {self.money()}  ISS {r.randrange(2, 6)}%",
            lambda: f"estimativa {self.money()}",
            lambda: r.choice(BANKS) + r.choice(["", " - cobrança registrada", "  Recibo do Pagador", "  BOLETO"]),
            lambda: f"Romaneio {self.num('99999')}",
            lambda: f"Ordem de serviço {self.num('9999999')}",
            lambda: f"Relatório de entrega {self.num('99999')}",
            lambda: r.choice(["Luiz", "BRENZUREL", "/", "Catarina", self.surname(), r.choice(GIVEN), "EMITENTE:"]),
            lambda: f"R$ {self.money()}",
        ]
        return [r.choice(forms)()]

    # noise ----------------------------------------------------------------
    # Letters and figures that readers take for each other.
    LOOKS = {"o": "0", "O": "0", "0": "O", "l": "1", "1": "l", "I": "1", "i": "í", "s": "5", "S": "5", "5": "S", "B": "8", "8": "B", "e": "c", "c": "e", "m": "rn", "rn": "m", "h": "b", "n": "r", "u": "v", "a": "e"}

    def noisy(self, parts: list, rate: float) -> list:
        r = self.r
        out = []
        for p in parts:
            text, kind = p if isinstance(p, tuple) else (p, None)
            s = ""
            for c in text:
                u = r.random()
                if u > rate:
                    s += c
                elif u < rate * 0.4:
                    s += "" if len(text) > 1 else c
                elif u < rate * 0.8:
                    s += self.LOOKS.get(c, c)
                elif u < rate * 0.9:
                    s += c + c
                else:
                    s += c if c != " " or kind is None and r.random() < 0.5 else ""
            out.append((s, kind) if kind and s else s)
        return out

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        """One training text and its spans (start, end, kind)."""
        r = self.r
        n = 1 if r.random() < 0.72 else r.choice([2, 2, 3])
        parts: list = []
        for k in range(n):
            if k:
                parts.append(" ")
            parts += self.personal() if r.random() < 0.62 else self.other()
        if r.random() < 0.3:
            parts = self.noisy(parts, r.choice([0.015, 0.03, 0.06]))
        if r.random() < 0.17:
            parts = [(p[0].upper(), p[1]) if isinstance(p, tuple) else p.upper() for p in parts]
        text, spans = "", []
        for p in parts:
            if isinstance(p, tuple) and p[0].strip():
                lead = len(p[0]) - len(p[0].lstrip())
                spans.append((len(text) + lead, len(text) + len(p[0].rstrip()), p[1]))
                text += p[0]
            else:
                text += p if isinstance(p, str) else p[0]
        return text, spans
