from __future__ import annotations

import duckdb

from evidara.functions import stem

# Published examples of the algorithm.
KNOWN = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news inning inning innings inning proceed proceed exceeded exceed generate generat general general generic generic communism communism ties tie cries cri gas gas this this gaps gap kiwis kiwi
hopping hop hoping hope luxuriated luxuri hissing hiss by by say say cry cri enjoy enjoy agreed agre feed feed national nation relational relat sensibility sensibl adoption adopt yes yes youth youth employer employ rate rate rolls roll controlled control
""".split()


def test_published_examples_and_the_sql_twin(spark):
    words, want = KNOWN[::2], KNOWN[1::2]
    rows = [(w,) for w in [*words, "año", "straßes", "x1s", "ab", "y", "", "2022"]]
    got = {r.word: r.stem for r in stem.with_stems(spark.createDataFrame(rows, "word string")).collect()}
    assert {w: got[w] for w in words} == dict(zip(words, want))
    assert [got[w] for w in ("x1s", "ab", "y", "", "2022")] == ["x1s", "ab", "y", "", "2022"]
    values = ", ".join(f"('{w}')" for (w,) in rows)
    assert dict(duckdb.connect().execute(stem.stems_sql(f"SELECT word FROM (VALUES {values}) AS v(word)")).fetchall()) == got
