from pyspark.sql import functions as F

from chronoline.llm import licenses


def brute(text):
    """n_words and the places of each phrase, read off character by character."""
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    places = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.summary(licenses.scan(docs, licenses.build_index(docs))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    return {r.doc_id: r for r in got}


def test_whole_table_against_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_cases(spark):
    texts = {
        1: "Released under THE MIT license. the MIT-License, under the mit license", 2: None, 3: "", 4: "cc by nc cc-by-nc CC BY nc4",
        5: "Licensed under the Apache License, Version 2.0.", 6: "mit der mit und the the mit " * 50,
        7: "This work is licensed under the GNU General Public License, version 3.",
        8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the Software), to deal in our Software without restriction",
        9: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:", 10: "version 3 of the general public gnu license", 11: "éthe mit licenseé",
        12: "filler " * 50000 + "under the mit license", 13: "licensed under the general public opinion", 14: "the mit license"}
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, labels string")
    got = check(docs)
    assert {k: got[k].labels for k in texts} == {
        1: "mit", 2: "", 3: "", 4: "cc-by-nc", 5: "apache-2", 6: "", 7: "gpl-3", 8: "mit", 9: "bsd", 10: "", 11: "",
        12: "mit", 13: "", 14: "mit"}
    # The bare name is no base phrase; it labels as a notice.
    assert (got[1].n_base, got[12].n_base, got[12].first_word, got[14].n_base, got[14].base_labels) == (2, 1, 50000, 0, "")
    assert got[7].score == 1.0 and got[2].score == 0.0 and 0.6 <= got[8].score < 1.0


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc")], "doc_id long, text string")
    rows = licenses.summary(licenses.scan(docs, licenses.build_index(docs))).collect()
    assert [r.n_base for r in rows] == [1, 1, 1] and sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    empty = docs.where(F.lit(False))
    assert licenses.scan(empty, licenses.build_index(empty)).count() == 0
