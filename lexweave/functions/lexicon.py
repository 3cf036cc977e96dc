"""Default word lists. Every function takes its list as a parameter."""

# Fixed values, here and below: they must equal the usual ones for equal results.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should",
    "can", "could", "may", "might", "must", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "out", "off", "over", "under", "again", "then", "once", "that", "this", "these", "those", "it", "its", "and",
    "or", "but", "nor", "so", "yet", "both", "either", "neither", "not", "no", "all", "any", "each", "every", "few", "more", "most", "other", "such",
    "same", "than", "too", "very", "just", "there", "their", "they", "them", "which", "who", "whom", "whose", "what", "when", "where", "how", "i", "me",
    "my", "we", "our", "you", "your", "he", "his", "she", "her", "if", "up", "about", "also", "s",
]
PHRASE_STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should",
    "may", "might", "can", "could", "must", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "and", "but", "or", "nor", "not", "so", "yet", "both",
    "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "than", "too",
    "very", "just", "because", "as", "until", "while", "it", "its", "he", "she", "they", "them", "their", "his", "her", "we", "us", "our", "you", "your",
    "my", "me", "one", "ones", "this", "that", "these", "those", "what", "which", "who", "whom", "how", "when", "where", "why",
]
PHRASE_PREPOSITIONS = [
    "by", "in", "on", "at", "for", "of", "with", "from", "up", "out", "off", "over", "into", "through", "about", "against", "between", "under", "above",
    "below", "after", "before", "during",
]
PLACEHOLDERS = {
    "be": ["be", "is", "are", "was", "were", "been", "being", "am"],
    "oneself": ["oneself", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves"],
    "one's": ["my", "your", "his", "her", "its", "our", "their"],
    "someone": ["someone", "somebody", "anyone", "anybody", "everyone", "everybody"],
    "do": ["do", "does", "did", "done", "doing"],
    "have": ["have", "has", "had", "having"],
}
PATTERN_MARKERS = ["do", "doing", "sth", "sb", "something", "somebody"]
PRONOUNS = [
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves",
]
RELATIVES = ["who", "whom", "whose", "which", "that", "whoever", "whomever", "whichever", "whatever"]
PREPOSITIONS = [
    "about", "above", "across", "after", "against", "along", "amid", "among", "around", "as", "at", "before", "behind", "below", "beneath", "beside",
    "besides", "between", "beyond", "by", "concerning", "despite", "down", "during", "except", "for", "from", "in", "inside", "into", "like", "near",
    "of", "off", "on", "onto", "out", "outside", "over", "past", "regarding", "since", "through", "throughout", "till", "to", "toward", "towards",
    "under", "underneath", "until", "up", "upon", "via", "with", "within", "without",
]
CONJUNCTIONS = [
    "although", "because", "since", "unless", "until", "whereas", "while", "though", "even", "if", "when", "whenever", "where", "wherever", "after",
    "before", "once", "so", "yet", "but", "and", "or", "nor", "however", "therefore", "furthermore", "moreover", "nevertheless", "nonetheless",
    "consequently", "accordingly", "thus", "hence", "provided", "given", "assuming", "whether", "both", "either", "neither",
]
AUXILIARIES = [
    "was", "were", "is", "are", "am", "has", "have", "had", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "be", "been",
    "being",
]
COMPARATIVES = [
    "more", "most", "less", "least", "better", "best", "worse", "worst", "further", "furthest", "farther", "farthest", "higher", "lower", "greater",
    "lesser",
]
# Question categories, and the keywords of their labels.
CATEGORIES = ["품사", "동사시제/태", "접속사/전치사", "관계대명사", "어휘", "대명사", "비교급/최상급", "기타문법"]
CATEGORY_KEYWORDS = {
    "품사": ["명사 자리", "형용사 자리", "부사 자리", "명사자리", "형용사자리", "부사자리", "품사"],
    "동사": ["동사 자리", "동사 어형", "동사 어휘", "동사자리", "동사어형", "동사 이행", "동사 이휘", "동사(과거분사)", "동명사", "to부정사", "현재분사", "과거분사", "분사구문", "목적격보어", "명령문"],
    "접속사/전치사": ["접속사", "전치사", "접속부사", "등위접속사", "상관접속사", "부사절 접속사", "명사절 접속사"],
    "관계대명사": ["관계대명사", "복합관계대명사", "복합관계사", "관계부사"],
    "어휘": ["명사 어휘", "형용사 어휘", "부사 어휘", "부사어휘", "동사 어휘", "부사구 어휘", "구전치사 어휘", "전치사 어휘", "전치사 이휘", "형용사_어휘", "명사 이휘", "동사 이휘", "소유격 대명사 어휘"],
    "대명사": ["대명사", "인칭대명사", "재귀대명사", "지시대명사", "부정대명사", "소유대명사"],
    "비교급/최상급": ["비교급", "최상급"],
    "기타문법": ["한정사", "수량 형용사", "수량형용사", "숫자"],
}
OTHER_CATEGORY = "기타문법"
# Word families, an ending and what may take its place.
FAMILY_RULES = [
    ("e", ["ion", "tion", "ation", "er", "or", "ment", "ence", "ance", "ed", "es", "ing", "ings"]),
    ("", ["ion", "tion", "ation", "ment", "ence", "ance", "er", "or", "ness", "ity", "al", "ous", "ive", "able", "ible", "ful", "ly", "s", "es", "ed", "ing", "ings"]),
    ("tion", ["t", "te", "tive", "tional", "tionally"]),
    ("sion", ["de", "se", "sive", "sional"]),
    ("ment", ["", "al", "ally"]),
    ("ness", ["", "less", "ful", "fully"]),
    ("ity", ["", "ous", "ize", "ization"]),
    ("ly", ["", "ness", "ful"]),
    ("ing", ["", "e", "ed", "er", "ion", "tion", "ment"]),
    ("ed", ["", "e", "ing", "er", "ion", "tion", "ment"]),
    ("er", ["", "e", "ing", "ed", "ion", "tion"]),
    ("ous", ["", "ness", "ly"]),
    ("ive", ["", "ness", "ly", "ity"]),
    ("able", ["", "ness", "bly", "ility"]),
    ("ible", ["", "ness", "bly", "ility"]),
    ("al", ["", "ly", "ize", "ism"]),
    ("ful", ["", "ly", "ness"]),
]
MIN_STEM = 3
# Endings that the fallback lemmatiser strips, in this order.
LEMMA_ENDINGS = ["tion", "sion", "ment", "ness", "ity", "ing", "ed", "er", "est", "ous", "ive", "able", "ible", "al", "ly", "ful"]
DEFAULT_ENDINGS = ["s", "es", "ed", "ing", "er", "ers", "est", "ly", "ment", "ments", "tion", "tions", "ness", "al", "ive", "ity"]
# Irregular plurals and verb forms.
IRREGULAR = {
    "woman": ["women"], "man": ["men"], "child": ["children"], "person": ["people"], "foot": ["feet"], "tooth": ["teeth"],
    "mouse": ["mice"], "goose": ["geese"], "ox": ["oxen"], "analysis": ["analyses"], "criterion": ["criteria"],
    "datum": ["data"], "phenomenon": ["phenomena"], "medium": ["media"], "index": ["indices"],
    "buy": ["bought"], "sell": ["sold"], "tell": ["told"], "find": ["found"], "make": ["made"], "take": ["took", "taken"],
    "give": ["gave", "given"], "come": ["came"], "go": ["went", "gone"], "know": ["knew", "known"], "think": ["thought"],
    "bring": ["brought"], "teach": ["taught"], "catch": ["caught"], "run": ["ran", "run"], "begin": ["began", "begun"],
    "write": ["wrote", "written"], "speak": ["spoke", "spoken"], "hold": ["held"], "build": ["built"], "send": ["sent"],
    "spend": ["spent"], "lend": ["lent"], "lead": ["led"], "meet": ["met"], "feel": ["felt"], "keep": ["kept"],
    "leave": ["left"], "lose": ["lost"], "pay": ["paid"], "say": ["said"], "hear": ["heard"], "read": ["read"],
    "win": ["won"], "sit": ["sat"], "stand": ["stood"], "understand": ["understood"], "withdraw": ["withdrew", "withdrawn"],
    "arise": ["arose", "arisen"], "drive": ["drove", "driven"], "prove": ["proved", "proven"], "rise": ["rose", "risen"],
    "choose": ["chose", "chosen"], "freeze": ["froze", "frozen"],
}
# Part of speech by ending, the first that fits.
SUFFIX_POS = [
    ("ement", "noun"),
    ("ament", "noun"),
    ("ation", "noun"),
    ("ition", "noun"),
    ("iness", "noun"),
    ("ously", "adverb"),
    ("ively", "adverb"),
    ("fully", "adverb"),
    ("ially", "adverb"),
    ("ently", "adverb"),
    ("antly", "adverb"),
    ("arily", "adverb"),
    ("ility", "noun"),
    ("ality", "noun"),
    ("ivity", "noun"),
    ("rable", "adjective"),
    ("ional", "adjective"),
    ("ative", "adjective"),
    ("itive", "adjective"),
    ("rical", "adjective"),
    ("tical", "adjective"),
    ("ment", "noun"),
    ("tion", "noun"),
    ("sion", "noun"),
    ("ness", "noun"),
    ("ance", "noun"),
    ("ence", "noun"),
    ("ical", "adjective"),
    ("able", "adjective"),
    ("ible", "adjective"),
    ("less", "adjective"),
    ("ity", "noun"),
    ("ism", "noun"),
    ("ist", "noun"),
    ("ant", "noun"),
    ("ent", "noun"),
    ("ive", "adjective"),
    ("ous", "adjective"),
    ("ful", "adjective"),
    ("ial", "adjective"),
    ("ory", "adjective"),
    ("ary", "adjective"),
    ("ize", "verb"),
    ("ise", "verb"),
    ("ify", "verb"),
    ("ate", "verb"),
    ("ure", "noun"),
    ("ly", "adverb"),
    ("er", "noun"),
    ("or", "noun"),
    ("al", "adjective"),
]
# Part of speech by the Korean gloss, the first pattern that is found.
GLOSS_POS = [
    ("verb", r"다\s*$|시키다"),
    ("adjective", r"적인|스러운|있는|없는|같은|로운\s*$|다운\s*$"),
    ("adverb", r"하게\s*$|적으로\s*$|히\s*$"),
    ("preposition", r"에도\s*불구하고|동안에?\s*$"),
    ("conjunction", r"때문에"),
]
# Parts of speech, blank mark, question numbers of the parts.
POS_NAMES = ["noun", "verb", "adjective", "adverb", "preposition", "conjunction", "pronoun", "phrase"]
POS_SHORT = {"n.": "noun", "v.": "verb", "adj.": "adjective", "a.": "adjective", "adv.": "adverb", "ad.": "adverb", "prep.": "preposition", "conj.": "conjunction", "phr.": "phrase"}
BLANK = "-------"
EXAM_PARTS = {5: (101, 130), 6: (131, 146), 7: (147, 200)}
# Rare categories that a sample pools.
POOLED_CATEGORIES = ["기타문법", "관계대명사", "비교급/최상급"]
# Parts of speech of single words, before any rule.
WORD_POS = {
    "although": "conjunction", "despite": "preposition", "however": "adverb", "therefore": "adverb", "nevertheless": "adverb", "furthermore": "adverb", "moreover": "adverb",
    "whereas": "conjunction", "unless": "conjunction", "whether": "conjunction", "while": "conjunction", "since": "conjunction", "because": "conjunction", "though": "conjunction",
    "once": "conjunction", "until": "conjunction", "if": "conjunction", "but": "conjunction", "and": "conjunction", "or": "conjunction", "nor": "conjunction", "yet": "conjunction", "so": "conjunction",
    "both": "adjective", "either": "adjective", "neither": "adjective",
    "between": "preposition", "among": "preposition", "during": "preposition", "throughout": "preposition", "regarding": "preposition", "concerning": "preposition", "within": "preposition",
    "without": "preposition", "beyond": "preposition", "upon": "preposition", "toward": "preposition", "towards": "preposition", "across": "preposition", "against": "preposition",
    "along": "preposition", "beside": "preposition", "besides": "preposition", "beneath": "preposition", "above": "preposition", "below": "preposition", "behind": "preposition",
    "ahead": "adverb", "prior": "adjective",
    "each": "adjective", "every": "adjective", "several": "adjective", "various": "adjective", "much": "adjective", "many": "adjective", "few": "adjective", "most": "adjective",
    "other": "adjective", "another": "adjective", "such": "adjective", "whole": "adjective", "entire": "adjective",
}
# Adjectives that end in -ly.
LY_ADJECTIVES = [
    "timely", "costly", "likely", "unlikely", "friendly", "unfriendly", "lovely", "lonely", "lively", "orderly", "elderly", "daily", "weekly", "monthly", "yearly", "quarterly", "hourly", "homely",
    "deadly", "ugly", "holy", "silly", "early", "worldly", "leisurely",
]
# Endings of a Korean gloss that make an adjective, those that do so in glosses of two
# letters or more that don't end in 다, and those that no noun has.
GLOSS_ADJECTIVE = r"(적인|있는|없는|스러운|로운|다운)$"
GLOSS_ADJECTIVE_WEAK = r"(한|된|운|난|큰|른|쁜|진|는|깊은|높은|좋은|많은|같은|없는)$"
GLOSS_NO_NOUN = r"(하다|시키다|되다|주다|받다|내다|보다|오다|가다|나다|있는|없는|적인|스러운|한|의|운|된|난|인|하게|히)$"
# A misread glyph and the letters it stands for.
GLYPHS = {"斤": "fr"}
