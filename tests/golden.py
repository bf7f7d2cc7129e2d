"""Expected-result input: the published sample tables without their texts, as literals.

A review is "user product rating date verified"; the last one is stored with a blank after its boolean, and
the date of the last product has one too.
"""

REVIEWS = """
u001 p123 5 2023-01-15 T; u002 p123 5 2023-01-16 T; u003 p123 1 2023-01-18 T; u004 p123 5 2023-01-20 T
u005 p456 5 2023-02-01 T; u006 p456 5 2023-02-02 T; u007 p456 2 2023-02-03 T; u008 p456 5 2023-02-04 T
u009 p789 5 2023-01-15 F; u010 p789 5 2023-01-15 F; u011 p789 5 2023-01-15 F; u012 p789 5 2023-01-16 F
u013 p789 5 2023-01-16 F; u014 p101 1 2023-03-10 T; u015 p101 4 2023-03-15 T; u016 p101 5 2023-03-20 T
u017 p202 5 2023-04-01 T; u018 p202 5 2023-04-05 T; u019 p202 3 2023-04-10 T; u020 p202 5 2023-04-15 T
u021 p303 5 2023-01-15 F; u022 p303 5 2023-01-15 F; u023 p303 5 2023-01-15 F; u024 p303 5 2023-01-16 F
u025 p303 5 2023-01-16 F; u026 p404 4 2023-05-01 T; u027 p404 2 2023-05-05 T; u028 p404 5 2023-05-10 T
u029 p505 1 2023-05-15 T; u030 p505 5 2023-05-20 T; u031 p606 5 2023-01-15 F; u032 p606 5 2023-01-15 F
u033 p606 5 2023-01-15 F; u034 p606 5 2023-01-16 F; u035 p606 5 2023-01-16 F; u036 p707 3 2023-06-01 T
u037 p707 4 2023-06-05 T; u038 p707 5 2023-06-10 T; u039 p707 2 2023-06-15 T; u040 p707 4 2023-06-20 T
u041 p123 5 2023-01-15 F; u042 p456 5 2023-01-15 F; u043 p789 5 2023-01-16 F; u044 p101 5 2023-01-16 F
u045 p202 5 2023-01-15 F; u046 p303 5 2023-01-16 F; u047 p404 5 2023-01-15 F; u048 p505 5 2023-01-16 F
u049 p606 5 2023-01-15 F; u050 p707 5 2023-01-16 F; u051 p123 4 2023-03-01 T; u052 p456 2 2023-03-05 T
u053 p789 5 2023-03-10 T; u054 p101 3 2023-03-15 T; u055 p202 4 2023-03-20 T; u056 p303 1 2023-04-01 T
u057 p404 5 2023-04-05 T; u058 p505 4 2023-04-10 T; u059 p606 3 2023-04-15 T; u060 p707 2 2023-04-20 T
"""

JOINED = """
u001 2020-05-15; u002 2018-11-23; u003 2021-02-10; u004 2019-07-05; u005 2017-08-12; u006 2022-01-30
u007 2021-04-18; u008 2020-09-22; u009 2023-01-10; u010 2023-01-12; u011 2023-01-09; u012 2023-01-11
u013 2023-01-10; u014 2019-03-25; u015 2018-10-14; u016 2020-11-30; u017 2017-05-01; u018 2021-07-12
u019 2019-12-05; u020 2018-04-22; u021 2023-01-03; u022 2023-01-05; u023 2023-01-04; u024 2023-01-08
u025 2023-01-09; u026 2020-02-14; u027 2019-05-30; u028 2018-08-17; u029 2021-01-25; u030 2020-07-11
u031 2023-01-02; u032 2023-01-03; u033 2023-01-05; u034 2023-01-07; u035 2023-01-08; u036 2018-03-19
u037 2019-08-05; u038 2020-10-12; u039 2021-05-20; u040 2017-12-01; u041 2023-01-10; u042 2023-01-11
u043 2023-01-08; u044 2023-01-09; u045 2023-01-07; u046 2023-01-12; u047 2023-01-06; u048 2023-01-08
u049 2023-01-10; u050 2023-01-13; u051 2018-06-10; u052 2019-09-28; u053 2020-12-15; u054 2021-03-07
u055 2017-10-30; u056 2019-11-19; u057 2018-05-23; u058 2020-08-09; u059 2021-06-14; u060 2017-07-22
"""

LISTED = """
p123 2022-11-15; p456 2022-10-20; p789 2023-01-05; p101 2022-12-10; p202 2022-09-05
p303 2023-01-01; p404 2022-08-15; p505 2022-07-20; p606 2023-01-10; p707 2022-11-01
"""

SOLE_UNFLAGGED_USER = "u056"
FLAGGED_PRODUCTS = {"p606", "p789"}


def _items(text):
    return [tuple(x.split()) for x in text.replace("\n", ";").split(";") if x.strip()]


def write_tables(folder):
    """CSV files as a user would have them; returns their paths (reviews, users, products)."""
    words = {"T": "True", "F": "False"}
    reviews = [f'{u},{p},{r},"text of {u}, on {p}",{d},{words[v]}' for u, p, r, d, v in _items(REVIEWS)]
    reviews[-1] += " "
    users = [f"{u},{d},1,4.0,1" for u, d in _items(JOINED)]
    products = [f'{p},Item 55",Kind,9.5,4.0,3,{d}' for p, d in _items(LISTED)]
    products[-1] += " "
    tables = {
        "reviews.csv": ["user_id,product_id,rating,review_text,date,verified_purchase", *reviews],
        "users.csv": ["user_id,join_date,review_count,avg_rating,verified_purchases", *users],
        "products.csv": ["product_id,product_name,category,price,avg_rating,review_count,listing_date", *products],
    }
    for name, lines in tables.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return [str(folder / name) for name in tables]
