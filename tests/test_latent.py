from marlspike.plans import texts


def test_rare_terms_and_spellings_are_in_the_matrix(spark, tmp_path):
    pages = [(p, [f"t{p}x{i}" for i in range(20)] * 2 + ["Common", " common"]) for p in range(30)]
    pages[7][1].append(" Castle ")
    pages[9][1].extend(["RAILWAY", " ", None])
    pages += [(30, ["castle"]), (31, None)]
    spark.createDataFrame(pages, "page_id long, terms array<string>").write.parquet(f"{tmp_path}/doctermmatrix.parquet")
    whole = texts._latent(spark, str(tmp_path))
    assert len(whole.vocabulary) == 603 and {"common", "castle", "railway"} < set(whole.vocabulary)
    assert 10 < len(whole.strengths) <= 30 and whole.terms.shape == (603, len(whole.strengths))
    best = whole.documents_for_query(["castle", "railway"], 3).collect()
    assert {r["doc_id"] for r in best[:2]} == {7, 9} and best[1]["score"] > 1 > best[2]["score"]
    assert len(whole.top_terms(100, 1)) == len(whole.strengths)
