from colloquy.llm.licenses import by_document, notices
from tests.llm.helpers import frame, prose

TEXTS = {
    1: ("apache", f"{prose(1, 40)}\nLicensed under the Apache License, Version 2.0.\n{prose(2, 9)}"),
    2: ("mit", "Released under the MIT License."),
    3: ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    4: ("cc-by-nc", f"{prose(3, 4)}\nLicensed under CC BY-NC 4.0."),
    5: ("apache,mit", "Licensed under the MIT license\n\nlicensed under the APACHE license, version 2.0"),
    6: ("", "The driver renewed a license and the public was free to use the software."),
    7: ("", prose(5, 300)),
    8: ("", None),
    9: ("", ""),
    10: ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    11: ("", "license"),
    12: ("lgpl", "// licensed under the GNU Lesser General Public License version 3"),
}


def test_families(spark):
    docs = frame(spark, [(i, t, None, None) for i, (_, t) in TEXTS.items()] + [(2, TEXTS[2][1], "en", "a")])
    got = by_document(docs, notices(docs)).collect()
    assert {r.doc_id: r.license for r in got} == {i: name for i, (name, _) in TEXTS.items()}
    assert len(got) == len(TEXTS) + 1
    assert all((r.license == "") == (r.n_notices == 0 == r.score) and 0 <= r.score <= 1 and 0 <= r.contained <= 1 for r in got)
    assert by_document(docs.limit(0), notices(docs.limit(0))).count() == 0


def test_grams_around_key_words(spark):
    from pyspark.sql import functions as F

    from colloquy.llm.licenses import grams, word_list

    texts = ["under the MIT license now", "mit", "", "no word of it", "license license mit x"]
    keys = ["mit", "license"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", grams(word_list(F.col("t")), keys).alias("g")).collect()
    for r in rows:
        ws = texts[r.i].lower().split()
        want = {" ".join(ws[p : p + n]) for n in (1, 2, 3) for p in range(len(ws) - n + 1) if set(ws[p : p + n]) & set(keys)}
        assert set(r.g) == want and len(r.g) == len(want)


WRAPPED = {
    1: ("bsd", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"),
    2: ("mit", " * Permission is hereby granted, free of charge, to any person obtaining a\n * copy of this software and associated documentation files (the \"Software\")"),
    3: ("gpl", "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by"),
    4: ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"),
    5: ("apache,mit", f"{prose(1, 30)} Released under the MIT License. {prose(2, 30)} Licensed under the Apache License, Version 2.0. {prose(3, 9)}"),
    6: ("apache,mit", "Licensed under the MIT license, licensed under the Apache License, version 2.0"),
    7: ("agpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation"),
    8: ("lgpl", "dnl licensed under the GNU Lesser\ndnl General Public License version 3"),
    9: ("", "a driver needs a license under the terms\nof the general public and software is free"),
}


def test_wrapped_and_joined_notices(spark):
    docs = frame(spark, [(i, t, None, None) for i, (_, t) in WRAPPED.items()])
    got = by_document(docs, notices(docs)).collect()
    assert {r.doc_id: r.license for r in got} == {i: name for i, (name, _) in WRAPPED.items()}
    assert {r.doc_id: r.n_notices for r in got} == {i: len([x for x in name.split(",") if x]) for i, (name, _) in WRAPPED.items()}
