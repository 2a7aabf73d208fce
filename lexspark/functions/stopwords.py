"""Words that the analyser leaves out."""

# The Polish stop list that results depend on.
POLISH = tuple(
    """
    a aby albo ale ani az aż bardzo bez bowiem by byc być byl byla byli bylo byly był była byli było były co coraz cos
    coś czy czyli dla do gdy gdyby gdyz gdyż gdzie i ich ile im inne inny iz iż ja jak jakie jako je jednak jednakze
    jednakże jego jej jest jesli jeśli jeszcze jezeli jeżeli juz już kazdy każdy kiedy kto ktora ktore ktorego ktorej
    ktory ktorych ktorym ktorzy która które którego której który których którym którzy lat lecz lub ma maja mają mi
    miedzy między mimo moga mogą moze może mozna można mu na nad nam nas nasz nawet nic nie niz niż no o od oraz po
    pod podczas ponadto poniewaz ponieważ potem poza przed przede przez przy raz sa są sie się sposob sposób swoje ta
    tak takie takze także tam te tego tej temu ten teraz tez też to tych tylko tym tys u w we wedlug według wiec więc
    wszystkie wszystkich z za zas zaś ze że zeby żeby
    """.split()
)
