"""A small labelled table of URLs, written by hand: what a crawl for training text wants (allow) and what it doesn't (block)."""

ALLOW = (
    "http://encyclopedia.example.org/wiki/history-of-glass", "http://encyclopedia.example.org/wiki/river-deltas", "https://www.citylibrary.example.org/guides/local-history",
    "https://science-review.example.com/articles/soil-and-climate", "https://science-review.example.com/articles/deep-sea-life", "https://news.example.com/articles/harvest-report",
    "https://news.example.com/articles/new-railway-line", "https://www.dailypost.example.net/news/world/elections", "https://www.dailypost.example.net/news/science/comet",
    "http://university.example.edu/courses/linear-algebra", "http://university.example.edu/research/papers/soil-study", "https://docs.example.io/manual/installation",
    "https://docs.example.io/manual/configuration", "https://museum.example.org/exhibits/bronze-age", "https://museum.example.org/history/collections",
    "https://garden-notes.example.com/articles/pruning-roses", "https://garden-notes.example.com/guides/compost", "https://cookbook.example.net/recipes/lentil-soup",
    "https://cookbook.example.net/recipes/rye-bread", "https://health.example.gov/guides/vaccination", "https://health.example.gov/publications/annual-report",
    "https://law.example.gov/publications/civil-code", "https://forum.example.org/discussions/telescope-mirrors", "https://journal.example.org/papers/medieval-trade",
    "https://journal.example.org/papers/bird-migration", "https://school.example.edu/lessons/fractions", "https://school.example.edu/lessons/grammar",
    "https://travel-notes.example.com/guides/mountain-huts", "https://travel-notes.example.com/articles/night-trains", "https://books.example.org/reviews/sea-novels",
    "https://books.example.org/library/essays", "https://weather.example.gov/publications/storm-records", "https://archive.example.org/documents/letters",
    "https://archive.example.org/history/newspapers", "https://wiki.example.net/wiki/sorting-algorithms", "https://wiki.example.net/wiki/photosynthesis",
    "https://research.example.edu/papers/language-change", "https://research.example.edu/articles/river-sediment", "https://blog.example.com/articles/learning-to-sail",
    "https://blog.example.com/guides/wood-joints",
)
BLOCK = (
    "http://luckycasino.example.com/slots/bonus", "http://luckycasino.example.com/jackpot/play-now", "http://grandcasino.example.net/roulette/free-spins",
    "http://casino-royal.example.org/poker/bonus", "https://bestpoker.example.com/casino/jackpot", "https://sportsbet.example.net/betting/odds-bonus",
    "https://betting-tips.example.com/bet/win-cash", "http://free-spins.example.org/slots/casino", "http://cheap-pills.example.com/buy/viagra",
    "http://cheap-pills.example.net/buy/discount-pills", "http://pharmacy-deals.example.com/buy-now/pills", "https://replica-watches.example.com/buy/cheap",
    "https://cheap-replica.example.net/buy-now/discount", "http://xxx-videos.example.com/porn/hot", "http://adult-chat.example.net/xxx/live",
    "http://hotgirls.example.com/adult/webcam", "http://porn-tube.example.net/videos/xxx", "http://adult-webcam.example.org/live/sex",
    "http://ads.example.com/click/track", "http://ads.example.net/banner/click", "http://adserver.example.com/ads/popup",
    "http://tracker.example.com/pixel/track", "http://track.example.net/click/redirect", "http://popup.example.org/ads/banner",
    "http://free-download.example.com/crack/keygen", "http://warez.example.net/download/crack", "http://torrent-warez.example.com/keygen/free-download",
    "http://keygen-crack.example.org/download/full", "http://fast-loans.example.com/payday/cash", "http://payday-loans.example.net/cash-now/loan",
    "http://win-cash.example.com/prize/click", "http://free-prize.example.net/win/claim-now", "http://get-rich.example.com/earn-cash/click",
    "http://miracle-diet.example.net/buy/pills", "http://seo-links.example.com/buy/backlinks", "http://cheap-backlinks.example.net/buy-now/seo",
    "http://crypto-bonus.example.com/win/jackpot", "http://free-crypto.example.net/claim/bonus", "http://login-verify.example.com/account/claim",
    "http://verify-account.example.net/login/click",
)
