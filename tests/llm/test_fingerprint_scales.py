from voxpop.llm import fingerprints as P

PROSE = "a near copy of a post that ends just at the border of both scales, with a few words more behind it"


def test_pairs_across_the_border_are_compared_on_one_scale(spark):
    short, long = PROSE[:63], PROSE[:65]
    assert P.likeness(P.sketch(short), P.sketch(long)) > 0.8 and P.likeness(P.sketch(long), P.sketch(short)) > 0.8
    rows = [(5, long), (4, short), (3, long), (2, PROSE[:90]), (1, None)]
    got = {r.doc_id: r for r in P.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].near_next > 0.8 for i in (5, 4))
    assert got[2].n_chars == 90 and got[2].near_edited > 0.5  # its edited text has 60 code points
    assert got[2].near_next == 0 and got[1].near_next == 0
