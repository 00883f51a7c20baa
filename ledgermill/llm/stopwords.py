"""Frequent function words by language."""

# Common words that running text of a language cannot do without.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be this by or from at an not".split(),
    "fr": "le la les de des du un une et est en que qui dans pour par sur pas avec au aux ne se il elle".split(),
    "de": "der die das und ist von den mit zu des im für nicht ein eine auf sich dem in als auch es".split(),
    "es": "el la los las de del y que en un una es por con no se para al lo como su más".split(),
}
