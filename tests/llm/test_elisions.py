from __future__ import annotations

from sonolith.llm import toxicity


def test_insults_behind_an_elision_count():
    lex = toxicity.Lexicon({"abruti": 4.0, "idiot|": 3.0})
    assert lex.evidence("Quelle bande d'abrutis.") == lex.evidence("Quelle bande abrutis.") == 4.0
    assert lex.evidence("Voici l'idiot.") == 3.0 and lex.evidence("Voici l'idiotie.") == 0
    assert lex.evidence("Tu parles d'abruti.") > 4.0
    assert lex.evidence("Jamais d'abruti.") < 4.0 and lex.evidence("It isn't abruti.") < 4.0
    assert lex.evidence("Il faut qu'ils soient abrutis.") > 4.0
