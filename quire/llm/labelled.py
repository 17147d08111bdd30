"""A small table of labelled urls, written out by hand: what a filter for training data would block, and what it would keep."""

from __future__ import annotations

#: Gambling, pills, adult content, scams, piracy and adverts. Most hosts are made up, in the manner of such sites.
BLOCK = """
https://www.luckyspin-casino.com/slots/mega-fortune
http://bet99.live/sports/odds?ref=aff31
https://pokerstack.net/bonus/no-deposit
https://blackjackhero.io/
http://m.roulettewheel24.com/en/play-now
https://jackpotcity-slots.ru/freespins
https://sportsbet-tips.info/today/sure-win
https://1xplay.bet/live/football
https://bingobonanza.co.uk/join?promo=FREE20
http://lotto-winner.biz/claim-ticket
https://crypto-dice.win/affiliate/88
https://www.gamblersparadise.com/vip
https://betking.ng/register
https://online-kasino-bonus.de/freispiele
https://casinoenligne-bonus.fr/jeux/roulette
https://apuestas-seguras.es/pronosticos
https://slotmania.xyz/777
https://parimatch-mirror.top/zerkalo
https://spinpalace-wins.online/deposit
https://highrollerclub.vip/baccarat
http://cheapviagra-online.com/buy/100mg
https://rx-meds24.net/order-without-prescription
https://cialis-generic.shop/discount
https://www.dietmiracle.co/keto-pills
https://buysteroids.eu/anabolic
https://pharmacyexpress.su/tramadol
http://weightlosspatch.info/lose-30-pounds
https://malegrowth.biz/enhancement-pills
https://xanax-overnight.com/checkout
https://onlineapotheke-ohne-rezept.de/potenzmittel
https://hgh-booster.store/special-offer
https://fatburner-extreme.net/testimonials
https://medsdirect.cc/painkillers
https://cannabis-oil-cure.com/miracle
https://pilule-minceur.fr/promo
https://www.hotcams.xxx/live/girls
http://freepornmovies.tv/videos/12345
https://adult-hookups.com/near-you
https://sexchat247.net/rooms
https://nudepics.club/gallery?id=9
https://escorts-in-town.com/vip-escorts
https://camgirlz.live/private
https://xxxtube.video/watch/99231
https://maturedating.sex/signup
https://hentai-stream.moe/episode/4
https://fetishworld.adult/forum
https://sexkontakte-heute.de/anzeigen
https://porno-gratuit.fr/amateur
https://videosxxx.mx/caseros
https://milfhunter.cam/join
https://get-rich-quick.biz/secret-system
http://free-iphone-winner.com/claim?uid=771
https://payday-loans-now.us/apply
https://your-account-verify.support/login/confirm
https://paypa1-secure.com/signin
https://bitcoin-doubler.cash/deposit
https://survey-rewards.club/giftcard
https://replica-watches.ru/rolex
https://mlm-millionaire.net/webinar
https://nigerian-transfer.info/beneficiary
https://cheap-luxury-bags.shop/outlet
https://workfromhome-5000.com/earn-daily
https://instant-credit-repair.biz/guaranteed
https://followers4free.com/instagram-likes
https://psychic-reading-free.net/love-spell
https://millionaire-trader.app/robot
https://antivirus-alert-warning.xyz/call-now
https://unclaimed-inheritance.org/form
https://gewinnspiel-gutschein.de/amazon-500
https://dinero-facil.mx/inversion-segura
https://forex-signals-vip.pro/profit
http://wallet-recovery.help/seed-phrase
https://www.warez-haven.to/software/full-version
http://torrentking.cc/magnet/8812
https://crackedapps.io/adobe-keygen
https://free-serials.net/activation-code
https://putlocker-movies.stream/watch/720p
https://nulled-scripts.ws/themes
https://modapk-unlimited.com/coins-hack
https://roms-pack.download/switch
https://ebook-pirate.lol/epub
https://iptv-m3u-free.tv/playlist
https://kinox-filme.to/stream/serie
https://telecharger-gratuit.ws/crack
https://gamehacks.gg/aimbot
https://leaked-albums.zone/320kbps
https://adserver.trackpixel.io/click?cid=552
http://popads-network.com/banner/728x90
https://redirect.clickfarm.biz/go/1189
https://cpa-offers.link/landing?sub=3
https://doubleclicks-stats.net/imp.gif
https://push-notify.club/subscribe
https://spamblaster.email/bulk-sender
https://buybacklinks.seo-juice.net/packages
https://autotraffic.bot/visitors
https://parked-domain.page/related-searches
https://articlespinner.info/unique-content
https://linkwheel.pw/pbn
https://doorway-pages.top/best-price-best-deal
https://expireddomains.sale/buy-now?src=ads
""".split()

#: Reference works, news, public services, schools, companies, software, hobbies, private pages. Most hosts are made up.
ALLOW = """
https://www.riverside-library.org/catalogue/search?q=maps
http://physics.northfield.edu/courses/mechanics/lecture3.pdf
https://museum-of-glass.org/exhibitions/2019
https://encyclopedia.openknowledge.net/wiki/Photosynthesis
https://archive.countyhistory.org.uk/parish/registers
https://mathpuzzles.io/geometry/problem-17
https://stadtbibliothek-neustadt.de/oeffnungszeiten
https://lycee-victor.fr/vie-scolaire/calendrier
https://universidad-delsur.mx/facultad/derecho
https://journal.marine-biology.org/articles/10.1234/mb.2020.17
https://thesis.repository.ac.uk/handle/1887/4432
https://dictionary.wordlore.com/define/serendipity
https://kinderbuch-verlag.de/neuerscheinungen
https://learnspanishverbs.net/subjunctive/exercises
https://www.dailyherald-post.com/world/2021/03/14/election-results
http://news.valleytimes.net/local/council-meeting
https://weather.coastalforecast.org/tides
https://lemondedujour.fr/economie/article/2020/inflation
https://elperiodico-regional.es/cultura/teatro
https://abendblatt-online.de/politik/kommentar
https://radiowaves.fm/programmes/morning-show
https://science-weekly.com/astronomy/new-comet-seen
https://sportgazette.co.uk/cricket/scorecards
https://podcast.historytalks.org/episodes/41
https://www.cityofbrookdale.gov/permits/building
https://transport.metroline.org/timetables/line-4
https://gemeinde-waldhausen.de/rathaus/formulare
https://mairie-saint-paul.fr/demarches/etat-civil
https://ayuntamiento-rioseco.es/tramites
https://healthservice.gov.example/vaccination/children
https://court-records.state.us/case/2018-334
https://census.statistics.gov/tables/population
https://firebrigade-westport.org/volunteer
https://nationalpark.trails.org/map/hiking
https://www.oakwood-primary.sch.uk/newsletters
https://hospital-stmary.org/departments/cardiology
https://patient-advice.net/asthma/inhalers
https://bluecross-vets.co.nz/puppy-care
https://dentist-hillstreet.com/appointments
https://yoga-in-the-park.org/schedule
https://docs.fastparser.dev/en/latest/tutorial.html
https://github-mirror.codehost.org/tools/sorter/issues/12
https://stack-answers.net/questions/77123/segfault-in-loop
https://packages.linuxdistro.org/stable/editors
https://blog.databaseinternals.com/b-trees-explained
https://api.weatherkit.io/v2/reference
https://compilers.tinylang.org/grammar
https://security-notes.org/advisories/2020-11
https://robotics-club.tech/arduino/line-follower
https://openstreetatlas.org/node/88123
https://retrocomputing.museum/amiga/disk-images-faq
https://wiki.gamedevs.org/Shaders
https://www.hansen-plumbing.com/services
http://bakery-sonnenschein.de/brot-und-broetchen
https://gardencentre-lilac.co.uk/roses/climbing
https://boulangerie-martin.fr/nos-pains
https://talleres-gomez.es/contacto
https://smithandsons-law.com/family-law/wills
https://architects-nordlys.dk/projects/harbour-house
https://olive-oil-farm.it/visit
https://furniture-maker.ca/oak-tables
https://wool-and-yarn.shop/patterns/sweater
https://seaview-guesthouse.ie/rooms
https://bike-repair-cafe.nl/werkplaats
https://printshop-express.com/business-cards
https://steelworks-industries.com/investors/annual-report
https://greenenergy-coop.org/solar/panels
https://logistics-baltic.lt/warehouses
https://paperclips-office.com/stationery
https://insurance-mutual.com/claims/how-to
https://grandmas-kitchen.net/recipes/apple-pie
https://vegan-lunchbox.blog/lentil-curry
https://sourdough-diary.com/starter/day-5
https://birdwatching-notes.org/species/kingfisher
https://chessopenings.club/sicilian/najdorf
https://knitting-circle.org/scarves
https://modelrailway.info/scale/h0
https://mountain-huts.ch/routes/glacier
https://sailing-log.net/atlantic/week2
https://photographywalks.com/lisbon/light
https://quilts-by-anna.com/gallery
https://beekeepers.org.au/hives/winter
https://family-tree-keller.name/generation/4
https://marathon-training.run/plans/beginner
https://theatre-royal-bath.org/season/hamlet
https://orchestra-philharmonia.com/concerts/mahler
https://poemsforchildren.net/animals/the-owl
https://folkmusicarchive.org/tunes/reel/61
https://film-society.org/screenings/silent-era
https://ceramics-studio.art/glazes
https://www.travel-journal.me/peru/cusco
https://anna-writes.blogspot.example/2014/06/rainy-days.html
https://familie-becker.de/urlaub/ostsee
https://the-smiths-abroad.com/moving-to-japan
https://jean-dupont.fr/cv
https://charity-wells.org/donate/water
https://scouts-troop12.org/camp/checklist
https://church-stjames.org/services/sunday
https://refugee-language-cafe.org/volunteering
https://foodbank-eastside.org/opening-hours
""".split()
