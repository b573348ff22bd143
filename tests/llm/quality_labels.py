"""The kind of 240 documents of the test tables at scale 0.1, drawn by the MD5 of their names and checked by hand: what isn't listed among them is prose."""

DRAWN = 240
LIST = """
mirror/0905/0001290 scanbox/1405/0001880 mirror/1103/0000017 inbound/1005/0000196 inbound/1409/0000230 inbound/1306/0000964 depot/1102/0001187 depot/1012/0002431
inbound/1407/0000635 inbound/2309/0000479 inbound/2007/0002816 scanbox/1508/0001731 inbound/0905/0001965 scanbox/2201/0001348 depot/1102/0001352 mirror/1305/0002299
inbound/2104/0002967 inbound/1011/0002926 inbound/1307/0001474 mirror/2310/0000149 scanbox/2006/0000206 scanbox/0910/0000735 depot/1411/0001835 mirror/2011/0000491
scanbox/1502/0001521 mirror/1306/0000289 inbound/2203/0002203 depot/1907/0002650 inbound/2006/0002891 depot/1610/0000487 inbound/1603/0002032 mirror/2310/0001409
inbound/0904/0002205 inbound/1401/0002105
""".split()
TABLE = """
depot/0909/0000645 inbound/1306/0002389 mirror/1908/0001480 inbound/1512/0002346 scanbox/1106/0000707 mirror/1009/0000481 depot/1311/0001249 inbound/1806/0001884
depot/1006/0002476 inbound/1905/0000370 scanbox/1809/0001989 inbound/1008/0002236 inbound/1311/0002254 mirror/1011/0001756 depot/1604/0000697 scanbox/2110/0001077
mirror/1109/0001742 inbound/2307/0001139
""".split()
JUNK = """
inbound/2104/0001287 scanbox/1807/0000804 scanbox/2205/0002128 depot/1305/0000034 depot/2009/0001151 mirror/1905/0002890 depot/1811/0000324 depot/1209/0001908
inbound/1911/0002260 mirror/1609/0002242 inbound/1002/0002026 depot/1908/0002485 scanbox/1105/0002717 inbound/1905/0002215 depot/2210/0000568 inbound/1109/0001322
depot/2111/0002172 scanbox/1407/0001640
""".split()
