"""The extraction plan on synthetic documents: values, states and warnings of every scenario, in one job."""

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import extract, geometry
from fieldloom.plans.spec import NAMES, Options
from fieldloom.sources import synthetic as s

#: The form of key 7.
EXPECTED = dict(zip(NAMES, ("10", "8.8", "28.8", "9", "8", "4", "8", "4.17", "2.27", "4.37", "E0000007", "Servicio escolar")))


@pytest.fixture(scope="module")
def base(spark):
    rows = s.forms(spark.createDataFrame([(7,)], "k long"), "k").collect()
    return {r.label: r.asDict() for r in rows}


def form(base, doc, **changes):
    """Cells of the base form under another name: labels map to a new value, a dict of changed members, or None to drop."""
    out = []
    for label, cell in base.items():
        change = changes.get(label, {})
        if change is not None:
            change = {"value": change} if isinstance(change, str) else change
            out.append(cell | {"doc_id": doc} | change)
    return out


def variant(label, names):
    return {f"{label} as {n}": {label: {"label": n}} for n in names}


DOCUMENTS = {
    "base": {},
    "fused": {"N° Ejes": {"joined": True}, "N° Ruedas": {"joined": True}},
    "masked_hash": {"Peso Neto": {"value": "######", "confidence": 0.0}},
    "masked_ocr": {"Peso Neto": {"value": "EEEEIEEEIE", "confidence": 0.0}},
    "missing": {"Ancho": None},
    "implausible": {"N° Ejes": "0"},
    "comma": {"Peso Neto": "8,8"},
    "weights": {"Peso Bruto": "1.5"},
    "overlap_kw": {"N° Asientos": {"cover": "Asientos"}},
    "overlap_kw2": {"N° Asientos": {"cover": "ROJOAsientos"}},
    "overlap_fuzzy": {"N° Asientos": {"cover": "VERDEAsiemtos"}},
    "overlap_destroyed": {"N° Asientos": {"cover": "VERDExslzmbts"}},
    "unparseable": {"N° Ejes": "varios"},
    "width": {"Ancho": {"value": "227", "confidence": 38.0}},
    "text": {},
    "no_header": {"Placa": {"value": "X"}} | {label: None for column in s.FORM for label, _ in column if label != "Placa"},
    "other_plate": {"Placa": "K81M22"},
    "noisy_plate": {"Placa": "TOO7R"},
} | variant("N° Ejes", ["Nº Ejes", "N Ejes", "N* Ejes", "N? Ejes", "Nro Ejes"]) | variant("N° Pasajer.", ["N° Pasajeros", "Nº Pasajeros", "N* Pasajer."]) | variant("Tipo Uso", ["Tipo de Uso"])


def tables(spark, cells):
    df = spark.createDataFrame([tuple(c[n.split()[0]] for n in s.CELLS.split(", ")) for c in cells], s.CELLS)
    return s.laid_out(df, F.col("doc_id") != "no_header"), s.sheets(df.select("doc_id").distinct(), "doc_id")


@pytest.fixture(scope="module")
def found(spark, base):
    tokens, pages = tables(spark, [c for name, changes in DOCUMENTS.items() for c in form(base, name, **changes)])
    requests = pages.select("doc_id", F.lit("T-007R").alias("plate"))
    reads = spark.createDataFrame([("width", s.line_center(3), "2.27", 95.0), ("text", s.line_center(1), "Servicio escola", 80.0)], "doc_id string, y_center int, crop_text string, crop_conf double")
    e = extract.extract(tokens.repartition(5), pages, requests, reads)
    fields = {(r.doc_id, r.field): r for r in e.results.collect()}
    warnings = {}
    for r in e.warnings.orderBy("doc_id", "ord").collect():
        warnings.setdefault(r.doc_id, []).append((r.code, r.field))
    return e, fields, warnings, {r.doc_id: r for r in e.documents.collect()}


def values(fields, doc):
    return {n: fields[doc, n].value_text for n in NAMES}


@pytest.mark.parametrize("doc", [d for d in DOCUMENTS if d in ("base", "fused", "comma", "overlap_kw", "overlap_kw2", "overlap_fuzzy", "other_plate", "noisy_plate") or " as " in d])
def test_all_values(found, doc):
    _, fields, warnings, documents = found
    assert values(fields, doc) == EXPECTED and documents[doc].found_count == 12
    assert all(fields[doc, n].valid and fields[doc, n].status == "extracted" for n in NAMES)
    codes = [c for c, _ in warnings.get(doc, [])]
    extra = {"overlap_fuzzy": ["LABEL_FUZZY_MATCH"], "other_plate": ["PLATE_MISMATCH"]}.get(doc, [])
    assert [c for c in codes if c != "LOW_CONFIDENCE_FIELD"] == extra and (doc == "fused" or codes == extra)


def test_geometry(found):
    _, _, _, documents = found
    d = documents["base"]
    assert (d.section_top, d.section_bottom, d.header_found, d.used_fallback_columns) == (s.TOP, s.FIRST_LINE + s.LEADING * (s.LINES + 1), True, False)
    d = documents["no_header"]
    assert (d.section_top, d.section_bottom, d.header_found, d.used_fallback_columns) == (0, s.HEIGHT, False, True)


@pytest.mark.parametrize("doc", ["masked_hash", "masked_ocr"])
def test_masked_values_are_unavailable(found, doc):
    _, fields, warnings, _ = found
    r = fields[doc, "PESO_NETO"]
    assert (r.status, r.value_text, r.ocr_confidence, r.valid, r.source_label) == ("unavailable", None, None, None, "Peso Neto")
    assert warnings[doc] == [("FIELD_UNAVAILABLE", "PESO_NETO")] and fields[doc, "PESO_BRUTO"].value_text == "28.8"


def test_missing_unparseable_implausible(found):
    _, fields, warnings, _ = found
    assert fields["missing", "ANCHO"].source_label is None and warnings["missing"] == [("FIELD_NOT_FOUND", "ANCHO")]
    assert fields["overlap_destroyed", "NUM_ASIENTOS"].status == "not_found" and fields["overlap_destroyed", "NUM_PASAJEROS"].value_text == "8"
    assert warnings["unparseable"] == [("UNPARSEABLE_VALUE", "NUM_EJES")] and fields["unparseable", "NUM_EJES"].source_label == "N° Ejes"
    r = fields["implausible", "NUM_EJES"]
    assert (r.status, r.value_text, r.valid) == ("extracted", "0", False) and warnings["implausible"] == [("VALIDATION_FAILED", "NUM_EJES")]
    assert warnings["weights"] == [("VALIDATION_FAILED", "PESO_BRUTO")] and fields["weights", "PESO_BRUTO"].valid


def test_readings_that_disagree(found):
    _, fields, warnings, _ = found
    assert (fields["width", "ANCHO"].value_text, fields["width", "ANCHO"].ocr_confidence) == ("2.27", 95.0)
    assert ("LOW_CONFIDENCE_FIELD", "ANCHO") in warnings["width"]
    assert fields["text", "TIPO_USO"].value_text == "Servicio escolar"


def test_documents_without_fields_are_rejects(found):
    e, _, warnings, _ = found
    assert [tuple(r) for r in extract.rejects(e.documents).collect()] == [("no_header", "TARGET_SECTION_NOT_FOUND")]
    assert warnings["no_header"][0] == ("SECTION_FALLBACK_USED", None)


def test_values_and_json(found):
    import json

    e, *_ = found
    assert extract.values(e.results).where("doc_id = 'base'").first().asDict() == {"doc_id": "base"} | EXPECTED
    out = {r.doc_id: json.loads(r.json) for r in extract.responses(e, Options(debug=True)).collect()}
    assert out["base"]["values"] == {n: v if n in ("NUM_PARTIDA", "TIPO_USO") else float(v) for n, v in EXPECTED.items()}
    assert out["masked_hash"]["fields"]["PESO_NETO"] == {"value": None, "status": "unavailable", "ocr_confidence": None, "valid": None, "source_label": "Peso Neto"}
    assert "no_header" not in out and list(out["base"]["fields"]) == NAMES and "debug" in out["base"]
    assert "debug" not in json.loads(extract.responses(e).first().json)


def test_strings_can_be_masked(spark, base):
    tokens, pages = tables(spark, form(base, "d", **{"N° Partida": "########"}))
    one = lambda o: extract.extract(tokens, pages, options=o).results.where("field = 'NUM_PARTIDA'").first()
    assert (one(Options()).status, one(Options()).valid) == ("extracted", False)
    assert one(Options(mask_strings=True)).status == "unavailable"


def test_column_geometry(spark, base):
    tokens, pages = tables(spark, form(base, "d"))
    got = geometry.columns(geometry.section_tokens(geometry.placed(tokens, pages))).orderBy("column_index").collect()
    assert [abs(r.label_left - x) <= 4 and r.colon_x == c for r, (x, c, _) in zip(got, s.PLACES)] == [True] * 3
    assert got[2].column_right == s.WIDTH and not any(r.fallback for r in got)




def test_no_table_of_documents_goes_through_the_driver(spark, base, monkeypatch):
    """Tables with rows of every document are merged, however small their files are."""
    plans, stored = [], extract.stored
    seen = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name)
    for module in (extract, extract.matching):
        monkeypatch.setattr(module, "stored", seen)
    tokens, pages = tables(spark, form(base, "d"))
    e = extract.extract(tokens, pages, pages.select("doc_id", F.lit("T-007R").alias("plate")))
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (e.warnings, extract.values(e.results))]
    assert len(plans) > 7 and any("SortMergeJoin" in p for p in plans)
    assert [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line] == []
