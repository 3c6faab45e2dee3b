"""Word lists and relation sets that results depend on."""

# Fallback stop words per language.
STOP_WORDS = {
    "eng": frozenset(
        "a an and are as at be been but by for from had has have he her his i in is it "
        "its of on or that the their they this to was were which will with you your".split()
    ),
    "ita": frozenset(
        "a ad al alla che chi ci con da dal dei del della di e ed gli ha ho i il in io "
        "la le lo ma mi ne nei nel nella no non o per più si sono su tra un una uno".split()
    ),
}

# Words added to the final stop list of reported topic words.
EXTRA_STOP_WORDS = frozenset({"said", "says", "also", "would", "could", "may"})

# Words that do not make a phrase content-bearing.
FUNCTION_WORDS = frozenset({
    "just", "like", "know", "dont", "don", "youre", "im", "ive", "thats",
    "really", "way", "going", "got", "want", "make", "think", "thing",
    "things", "lot", "yeah", "okay", "ok", "good", "bad", "people", "said",
})

# Dependency relations that become graph edges by default.
GRAPH_RELATIONS = frozenset({
    "nsubj", "nsubjpass", "obj", "dobj", "iobj", "amod", "nmod", "compound",
    "conj", "xcomp", "ccomp", "advcl", "relcl", "appos", "attr", "pobj",
})

# Relation sets of the graph modes.
FILTERED_RELATIONS = frozenset({
    "nsubj", "obj", "dobj", "amod", "nmod", "compound", "conj", "xcomp",
})
FULL_RELATIONS = GRAPH_RELATIONS | {"advmod", "npadvmod"}
MODE_RELATIONS = {
    "none": frozenset(),
    "no_syntax": frozenset(),
    "full_dep": FULL_RELATIONS,
    "filtered": FILTERED_RELATIONS,
}

# Relations whose pairs count as multiword expressions.
MWE_RELATIONS = frozenset({"amod", "compound", "nmod", "flat", "fixed", "det"})

# Connector words allowed inside a collocation.
CONNECTOR_WORDS = frozenset(
    "a an the for of with without at from to in on by and or".split()
)
