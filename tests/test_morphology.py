from lexweave.functions import morphology as M


def test_residuals():
    assert M.residual("서울본부") == ("SUFFIX_WITH_MODIFIER", ("서울", "본부"), ("UNKNOWN_PART", "ORG_UNIT"))
    assert M.residual("호랑이")[0] == "UNKNOWN" and M.residual("")[1] == ()
    assert M.residual("위원장")[1] == ("위원장",) and M.residual("지사", "도")[2] == ("ROLE",) and M.residual("지사", "전")[2] == ("ORG_UNIT",)
    assert set(M.SUFFIXES.values()) | {"UNKNOWN_PART", "UNKNOWN"} == set(M.READINGS) and len(M.SUFFIXES) == 86
