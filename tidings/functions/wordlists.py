"""Fixed values that must equal the original application's for equal results.

Kept together, as plain text, in their natural order.
"""

# Fixed value: letters kept by the tagging text cleaner (lower-case Russian
# alphabet, hyphen and space).
RU_KEEP = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя- "

# Fixed value: the public NLTK Russian stop-word list (151 words), in order.
RU_STOPWORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за "
    "бы по только ее мне было вот от меня еще нет о из ему теперь когда даже "
    "ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь "
    "там потом себя ничего ей может они тут где есть надо ней для мы тебя их "
    "чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот "
    "того потому этого какой совсем ним здесь этом один почти мой тем чтобы "
    "нее сейчас были куда зачем всех никогда можно при наконец два об другой "
    "хоть после над больше тот через эти нас про всего них какая много разве "
    "три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя "
    "такой им более всегда конечно всю между"
).split()

# Fixed value: part-of-speech tags whose words are dropped by the topic
# lemmatiser (pronoun, predicative, preposition, conjunction, particle,
# interjection, verb).
EXCLUDED_POS = ["NPRO", "PRED", "PREP", "CONJ", "PRCL", "INTJ", "VERB"]

# Fixed value: topic names, in the order of the topic model's components.
TOPIC_NAMES = [
    "нормативные проверки",
    "поставки",
    "законы",
    "налоги и проверки",
    "валюта",
    "банки",
    "судебные дела",
    "инвестиции",
    "торговля",
    "недвижимость",
]

# Fixed value: Russian month names in the genitive case, January..December.
RU_MONTHS_GENITIVE = [
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
]

# Fixed value: maximum URL length accepted by the record validator.
MAX_URL_LENGTH = 2083
