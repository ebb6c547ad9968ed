from marlspike.llm import reading


def test_unknown_words_do_not_lean_to_the_level_with_fewest_tokens(spark, monkeypatch):
    monkeypatch.setattr(reading, "VOCABULARY", 6)
    texts = [(i, "a dog ran. we see him. " * 4) for i in range(10)]
    texts += [(100 + i, "institutional interdependence characterizes " * 30 + ".") for i in range(20)]
    rare = " ".join(f"unimaginabilit{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))
    texts.append((200, f"institutional interdependence characterizes {rare}."))
    found = reading.reading_levels(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    bands = {r[0]: r[1] for r in found.select("id", reading.band_of(found["level"])).collect()}
    assert bands == {i: "easy" if i < 100 else "hard" for i, _ in texts}
