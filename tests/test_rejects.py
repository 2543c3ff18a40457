from decimal import Decimal

from tidemark.operators.rejects import failing_records, strict_load

GOOD = "TT1,A-1,o,c,10.5,7,CL"
CASES = {
    1: (GOOD, None),
    2: ('"TT,1","A""1",o,c,1,7,', "external_receipt_id"),
    3: ('TT1,A-1,o,c,"1 234,565 ₽",12.0,"x, ""y""\nz"', None),
    4: ('TT1,A-1,o,c,"1,7,', "quoting"),
    5: ('TT1,A"1,o,c,1,7,', "quoting"),
    6: ('TT1,"A1" ,o,c,1,7,', "quoting"),
    7: ("TT1;A;o;c;1;7;", "column_count"),
    8: ("TT1,A,o,c,1,7,,", "column_count"),
    9: ("TT1,,o,c,1,7,", "external_receipt_id"),
    10: ("TT1," + "a" * 129 + ",o,c,x,y,", "external_receipt_id"),
    11: ("TT1,A,o,c,12345678901,y,", "amount"),
    12: ("TT1,A,o,c,-1.,7,", "amount"),
    13: ("TT1,A,o,c,,,", None),
    14: ("TT1,A,o,c,-0 010 0,1000,", "table_number"),
    15: ("TT1,A,o,c,1,07,", "table_number"),
    16: ("TT1,A,o,c,1,7\n,", "table_number"),
    17: (None, "column_count"),
    18: ("", "column_count"),
    19: ("TT1,A,o,c, ,7,", "amount"),
    20: ('"","A","","","","",""', None),
    21: ('TT1,A,o,c,"1\u00015",7,', "amount"),
    23: ("TT1,A,o,c,9999999999.999,7,c\u0001d", None),
    24: ('TT1,A,o,c,0.00499999999999999999999999,7,"\u0001c,\u0001"', None),
    22: ("TT1,A,o,c,1,7," + '"' + "y" * 300_000 + '""' * 2000 + '"', None),
}


def test_reasons_and_typed_rows(spark):
    df = spark.createDataFrame([(i, s, "clash", 1) for i, (s, _) in CASES.items()], "line_id bigint, raw_line string, offset string, f int")
    got = {r.line_id: r.reason for r in failing_records(df, "line_id", "raw_line").collect()}
    assert got == {i: r for i, (_, r) in CASES.items() if r}
    loaded = {r.line_id: r for r in strict_load(df, "line_id", "raw_line").collect()}
    assert set(loaded) == {i for i, (_, r) in CASES.items() if not r}
    assert loaded[3].amount == Decimal("1234.57") and loaded[3].table_number == 12 and loaded[3].client_external_id == 'x, "y"\nz'
    assert loaded[23].amount == Decimal("10000000000.00") and loaded[23].client_external_id == "c\u0001d"
    assert loaded[24].amount == Decimal("0.00") and loaded[24].client_external_id == "\u0001c,\u0001"
    assert loaded[13].amount is None and loaded[20].tt is None


def test_empty(spark):
    df = spark.createDataFrame([], "line_id bigint, raw_line string")
    assert failing_records(df, "line_id", "raw_line").count() == 0
