"""Default lists of junk URLs: hosts of advertisements, and patterns built from words."""

# Hosts that equal results need.
JUNK_DOMAINS = tuple("""
1ad.prolinks.de 1st-fuss.com 247media.com admaximize.com adbureau.net adsolution.de adwisdom.com advertising.com atwola.com aladin.de
annonce.insite.dk a.tribalfusion.com avenuea.com bannercommunity.de banerswap.com bizad.nikkeibp.co.jp bluestreak.com bs.gsanet.com cash-for-clicks.de
cashformel.com cash4banner.de cgi.tietovalta.fi cgicounter.puretec.de click-fr.com click.egroups.com commonwealth.riddler.com comtrack.comclick.com
customad.cnn.com cybereps.com:8000 cyberclick.net dino.mainz.ibm.de dinoadserver1.roka.net disneystoreaffiliates.com dn.adzerver.com doubleclick.net
ds.austriaonline.at einets.com emap.admedia.net eu-adcenter.net eurosponser.de fastcounter.linkexchange.com findcommerce.com flycast.com focalink.com
fp.buy.com globaltrack.com globaltrak.net gsanet.com hitbox.com hurra.de hyperbanner.net iadnet.com image.click2net.com image.linkexchange.com
imageserv.adtech.de imagine-inc.com img.getstats.com img.web.de imgis.com james.adbutler.de jmcms.cydoor.com leader.linkexchange.com linkexchange.com
link4ads.com link4link.com linktrader.com media.fastclick.net media.interadnet.com media.priceline.com mediaplex.com members.sexroulette.com
newsads.cmpnet.com ngadcenter.net nol.at:81 nrsite.com offers.egroups.com omdispatch.co.uk orientserve.com pagecount.com preferences.com
promotions.yahoo.com pub.chez.com pub.nomade.fr qa.ecoupons.com qkimg.net resource-marketing.com revenue.infi.net sam.songline.com sally.songline.com
sextracker.com smartage.com smartclicks.com spinbox1.filez.com spinbox.versiontracker.com stat.onestat.com stats.surfaid.ihost.com
stats.webtrendslive.com swiftad.com tm.intervu.net tracker.tradedoubler.com ultra.multimania.com ultra1.socomm.net uproar.com usads.imdb.com
valueclick.com valueclick.net victory.cnn.com videoserver.kpix.com view.atdmt.com webcounter.goweb.de websitesponser.de werbung.guj.de wvolante.com
www.ad-up.com www.adclub.net www.americanpassage.com www.bannerland.de www.bannermania.nom.pl www.bizlink.ru www.cash4banner.com www.clickagents.com
www.clickthrough.ca www.commision-junction.com www.eads.com www.flashbanner.no www.mediashower.com www.popupad.net www.smartadserver.com
www.smartclicks.com:81 www.spinbox.com www.sponsorpool.net www.ugo.net www.valueclick.com www.virtual-hideout.net www.web-stat.com www.webpeep.com
www.zserver.com www3.exn.net:80 xb.xoom.com yimg.com
""".split())

#: Words of which advertisement paths are made.
_WORDS = ("ad", "ads", "adv", "advert", "adverts", "advertising", "advertisement", "banner", "banners", "popup", "popups", "sponsor", "sponsors", "promo", "promos", "affiliate", "tracker", "webbug", "clickthru")
#: Names of scripts and servers that deliver them.
_SERVERS = ("adserv", "adserver", "adclick", "adcycle", "adimage", "adimages", "adview", "adlog", "adpopup", "adstream", "bannerfarm", "bannermedia", "clickserve", "doubleclick", "openads", "phpads")


def junk_patterns(words: tuple[str, ...] = _WORDS, servers: tuple[str, ...] = _SERVERS) -> tuple[str, ...]:
    """Patterns of junk URLs: a word as a whole directory, host label or file name before its ending, and servers' names as a part of one."""
    return tuple(rf"(?i)[/.]{w}[-_0-9]*([/.?]|$)" for w in words) + tuple(rf"(?i)[/.][^/.]*{s}[^/]*" for s in servers)
