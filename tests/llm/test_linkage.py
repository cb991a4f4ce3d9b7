import pytest

from ledgerloom.llm.linkage import repeated_documents
from ledgerloom.llm.paper import kind_of_number, near, read_number, read_paper

SLIP = "Banco X  Recibo do Pagador\nBeneficiário ACME PNEUS LTDA\nVencimento {due}\nNº documento {no}  parcela {part}/3\n(=) Valor do documento R$ {amt}\nData do processamento {made}"
COLS = "id long, lote_id int, file_hash string, raw_text string, doc_type string, doc_number string, access_key string, sig string"


def slip(due="10/02/2024", no=12345, part=1, amt="100,50", made="10/01/2024"):
    return SLIP.format(due=due, no=no, part=part, amt=amt, made=made)


def test_read_paper():
    r = read_paper(slip())
    assert (r["kind"], r["number"], r["part"], r["due"], r["made"], r["amount"], r["issuer"]) == ("BOLETO", "12345", "1", "10022024", "10012024", "10050", "acme pneus ltda")
    n = read_paper("Banco X  Rccibo do Pagador\nBenefciário ACME\nVencirnento 1O/02/2024\nNº documcnto 12345\n(=) alor do docurnento R$ 1OO,50\nData do proccssamento 10/01/2024")
    assert (n["number"], n["due"], n["made"], n["amount"]) == ("12345", "10022024", "10012024", "10050")
    b = read_paper("Beneficiário ACME\nVencimento\n10/02/2024\nNº documento\n12345\n(=) Valor do documento\nR$ 10,00")
    assert (b["due"], b["number"], b["amount"]) == ("10022024", "12345", "1000")
    assert set(read_paper(None).values()) == set(read_paper(" ").values()) == {None}
    assert read_paper("x" * 100_000)["kind"] is None


@pytest.mark.parametrize("raw, want", [("NF 71770 PARC 6", ("71770", "6")), ("71770 2/6", ("71770", "2")), ("071770/5", ("71770", "5")), ("64.148", ("64148", None)), ("32841-U", ("32841", None)), ("000264345711", ("264345711", None)), ("", (None, None)), (None, (None, None)), ("abc", (None, None))])
def test_read_number(raw, want):
    assert read_number(raw) == want


def test_near_and_kind():
    assert near("abc", "abd", 2) == 1 and near("abc", "xyz", 2) == 3 and kind_of_number("Aut. 12") == "COMPROVANTE" and kind_of_number(None) is None


@pytest.fixture(scope="module")
def rows():
    other = [slip(no=50000 + k, due=f"{k + 1:02d}/03/2024", amt=f"{k + 10},17", made=f"{k % 28 + 1:02d}/02/2024") for k in range(24)]
    base = [
        (1, 1, "a" * 32, slip(), "BOLETO", "12345-1", None),
        (2, 1, "b" * 32, slip(part=2, due="10/03/2024"), "BOLETO", "12345-2", None),
        (3, 2, "md5:" + "A" * 32, slip(), "BOLETO", None, None),
        (4, 2, "c" * 32, slip().upper(), "UNKNOWN", None, None),
        (5, 3, "d" * 32, slip(amt="10O,50").replace("Vencimento", "Vencirnento"), "BOLETO", "012345/1", None),
        (6, 3, "d41d8cd98f00b204e9800998ecf8427e", slip(no=777, due="11/05/2024"), "BOLETO", None, None),
        (7, 3, "d41d8cd98f00b204e9800998ecf8427e", slip(no=778, due="12/06/2024", made="01/05/2024", amt="9,99"), "BOLETO", None, None),
        (8, None, "e" * 32, None, "BOLETO", None, None),
        (9, 4, None, "", "BOLETO", None, None),
        (10, 4, None, None, "NFE", None, "97220281132677000195550010000516861922841393"),
        (11, 4, "bad", None, "NFE", None, "NFe9722 0281 1326 7700 0195 5500 1000 0516 8619 2284 1393"),
        (12, 4, "f" * 32, slip(due="10/04/2024", made="10/03/2024"), "BOLETO", "12345-1", None),
        (13, 5, "a" * 32, slip(), "BOLETO", None, None),
        (None, 5, "a" * 32, slip(), "BOLETO", None, None),
    ]
    return [(*r, "clash") for r in base + [(100 + k, 1 + k % 4, f"{k:032x}", t, "BOLETO", None, None) for k, t in enumerate(other)]]


WANT = [(1, 3), (1, 4), (1, 5), (1, 13), (10, 11)]


@pytest.mark.parametrize("waves", [1, 3, None])
def test_same_result_in_one_wave_or_many(spark, rows, waves):
    got = sorted(map(tuple, repeated_documents(spark.createDataFrame(rows, COLS), waves=waves).collect()))
    assert got == WANT


def test_history_is_opened_again(spark, rows, tmp_path, monkeypatch):
    """Batches accepted by several openings of one folder, with merged parts and a batch that failed halfway, give the same pairs."""
    from ledgerloom.llm import linkage
    from ledgerloom.llm.linkage import History, accept, pairs_of, read_rows

    monkeypatch.setattr(linkage, "MERGE", 2)
    path, read = tmp_path.as_uri() + "/h", read_rows(spark.createDataFrame(rows, COLS))
    h = History(spark, path, 3)
    h.learn(read)
    weights = h.weights
    accept(h, read.filter("lote_id <= 2"))
    again = History(spark, path)
    assert again.meta["buckets"] == 3 and again.weights == {k: list(v) for k, v in weights.items()}
    again.write("members", read.selectExpr("id", "id as sid", "hash"), again.meta["next"])  # fails before it is committed
    for cond in ("lote_id = 3", "lote_id = 4", "lote_id > 4 or lote_id is null"):
        accept(History(spark, path), read.filter(cond))
    last = History(spark, path)
    assert len(last.parts()) < 4 and last.read("members").count() == len(rows) - 1
    assert sorted(map(tuple, pairs_of(last).collect())) == WANT


def test_probe_leaves_history_in_place(spark, rows, tmp_path):
    """The probe of the key table needs no exchange of the table: its buckets are joined as they lie."""
    from ledgerloom.llm.linkage import History, accept, read_rows

    h = History(spark, tmp_path.as_uri() + "/h", 3)
    accept(h, read_rows(spark.createDataFrame(rows, COLS)))
    probe = h.read("keys").hint("shuffle_hash").alias("a").join(h.read("keys").alias("b"), "key")
    assert "Exchange" not in probe._jdf.queryExecution().executedPlan().toString()


def test_no_length_decides():
    """Long company names after the opening words, long label cells and short lines with several labels."""
    assert read_paper("NF-e da Empresa Acme")["kind"] == read_paper("NF-e da Empresa Acme Com Nome Longo Ltda")["kind"] == "NFE"
    assert read_paper("Vencimento 10/02/2024 Nº documento 12345")["number"] == "12345"


def test_empty(spark, rows):
    assert repeated_documents(spark.createDataFrame([], COLS)).count() == 0


def test_slips_with_lost_dates_meet(spark, rows):
    """Against brute force: copies of a slip share a key whichever dates are lost, and are linked with one date lost on each."""
    import itertools

    from ledgerloom.llm.linkage import key_texts, read_rows

    lost = [(due, made) for due in ("10/02/2024", "") for made in ("10/01/2024", "")]
    papers = [(no, part) for no in (60001, 60002) for part in (1, 0)]
    scans = [(200 + i, p, slip(due, p[0], p[1], "812,33", made)) for i, (p, (due, made)) in enumerate(itertools.product(papers, lost))]
    df = spark.createDataFrame([(i, 9, None, t, "BOLETO", None, None, None) for i, _, t in scans], COLS)
    keys = {r["id"]: set(r["k"]) for r in read_rows(df).select("id", key_texts().alias("k")).collect()}
    alike = {(a[0], b[0]) for a, b in itertools.combinations(scans, 2) if a[1] == b[1]}
    assert alike <= {(x, y) for x, y in itertools.combinations(sorted(keys), 2) if keys[x] & keys[y]}
    two = [(300, 5, None, slip("", 60003, 1, "77,10"), "BOLETO", None, None, None), (301, 6, None, slip("10/02/2024", 60003, 1, "77,10", ""), "BOLETO", None, None, None)]
    got = sorted(map(tuple, repeated_documents(spark.createDataFrame([*rows, *two], COLS)).collect()))
    assert got == [*WANT, (300, 301)]
