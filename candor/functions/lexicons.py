"""Word lists and other fixed values of the text operators."""

# The English function words that tokenisation may drop.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't
wouldn wouldn't
""".split()

# Sentiment lexicons.  Two exaggerated words carry a hyphen, which cleaning removes,
# so they never match; they stay listed because the lexicon is part of the specification.
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "awesome", "fantastic", "wonderful", "best", "love",
    "perfect", "happy", "recommend", "pleased", "impressive", "outstanding", "superb", "brilliant",
    "delightful",
]
NEGATIVE_WORDS = [
    "bad", "poor", "terrible", "awful", "worst", "horrible", "disappointed", "waste", "useless", "hate",
    "broken", "defective", "refund", "return", "complaint", "disappointing", "regret",
]
EXAGGERATED_WORDS = [
    "best", "greatest", "amazing", "awesome", "incredible", "unbelievable", "perfect", "exceptional",
    "outstanding", "revolutionary", "mind-blowing", "astonishing", "spectacular", "phenomenal",
    "life-changing", "miraculous",
]

# The shorter lexicon of the single-review sentiment mix.
MIX_POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "perfect"]
MIX_NEGATIVE = ["bad", "poor", "terrible", "awful", "worst", "not", "never"]

# ASCII punctuation, the punctuation counted by the linguistic features, and the
# six fused words that word tokenisation takes apart.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
COUNTED_PUNCTUATION = ".,;:!?\"-()[]{}"
FUSED_WORDS = {
    "cannot": ("can", "not"),
    "gimme": ("gim", "me"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "lemme": ("lem", "me"),
    "wanna": ("wan", "na"),
}
