"""Explicit schemas of all file sources."""

QUESTION = (
    "id string, volume int, test int, part int, question_number int, sentence string, choices map<string,string>, answer string, "
    "category string, explanation string, translation string, vocabulary string, deleted boolean"
)
PASSAGE = "id string, volume int, test int, part int, raw_text string, answer map<string,string>, explanation map<string,string>, deleted boolean"
VOCAB = (
    "id string, word string, pos string, meaning_kr string, meaning_en string, day int, level string, frequency string, "
    "synonyms array<string>, related_words array<string>, example_sentence string, example_translation string"
)
EXAM_RESULT = (
    "test_file string, submitted_at string, total int, score int, elapsed_seconds int, "
    "questions array<struct<index int, id string, correct_answer string, user_answer string, is_correct boolean, category string>>"
)
PATCH = "word string, idx int, new_sentence string"
