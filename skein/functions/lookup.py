"""Lookup values.

Fixed values: these lists, orders and patterns have to be as they are for equal results.
"""

PORTS = {"http": 80, "ftp": 21, "https": 443, "file": 0}

IMAGE = (
    ".bmp .dib .dcx .emf .fpx .gif .ico .img .jp2 .jpc .j2k .jpf .jpg .jpeg .jpe .mng .pbm .pcd .pcx .pgm .png .ppm .psd .ras .rgb .tga .tif .tiff .wbmp .xbm .xpm"
).split()
MOVIE = (
    ".3gp .avi .asf .asx .avs .bay .bik .bsf .dat .dv .dvr-ms .flc .flv .ivf .m1v .m2ts .m2v .m4v .mgv .mkv .mov .mp2v .mp4 .mpe .mpeg .mpg .ogm .qt .ratDVD .rm .smi .vob .wm .wmv .xvid"
).split()
SOUND = (
    ".aac .aif .aiff .aifc .aifr .amr .ape .asf .au .aud .aup .bwf .cda .dct .dss .dts .dvf .esu .eta .flac .gsm .jam .m4a .m4p .mdi .mid .midi .mka .mod .mp1 .mp2 .mp3 .mpa .mpc .mpega .msv .mus "
    ".nrj .nwc .nwp .ogg .psb .psm .ra .ram .rel .sab .shn .smf .snd .speex .tta .vox .vy3 .wav .wave .wma .wpk .wv .wvc"
).split()
WEBPAGE = ["", *".htm .html .shtm .shtml .php .php3 .php4 .asp .aspx .jsp .psp .pl .cgi .stx .cfm .cfml .cms .ars".split()]
DOCUMENT = ".doc .rtf .odt .odp .ott .sxw .stw .sdw .vor .pdf .ps".split()
FLASH = ".swf .fla .mxml .as .abc".split()
STYLESHEET = [".css"]
#: Extensions whose pages are directories as well.
DIRECTORY = [".ars"]

#: Characters that no local file name may hold.
JUNK_CHARACTERS = ["?", "*", '"', "<", ">", "!", ":", "/", "\\"]
#: Characters that a URL has to escape, besides white space.
DIRTY_CHARACTERS = ["<", ">", "(", ")", "{", "}", "[", "]", "^", "`", "|"]

PARAMETER = r"([^&=\?]*=[^&=\?]*)"
FULL_PARAMETER = r"^[^&=\?]+=[^&=\?\s]+"

#: Generic top-level domains; two letters make a country's.
GENERIC_TLDS = "aero arpa asia biz cat com coop edu gov info int jobs mil mobi museum name net org pro tel travel".split()

#: URL types and their parents.
PARENT_TYPE = {
    "generic": None, "none": "generic",
    "webpage": "generic", "base": "webpage", "anchor": "webpage", "frameset": "webpage", "frame": "webpage",
    "query": "generic", "form": "query", "image": "generic",
    "multimedia": "generic", "audio": "multimedia", "video": "multimedia", "flash": "multimedia",
    "stylesheet": "generic", "javascript": "generic", "javaapplet": "generic", "appletcodebase": "generic", "file": "generic", "document": "generic",
}

#: HTTP statuses by what follows from them; any other is tried again.
FATAL_STATUS = [401, 402, 403, 404, 409, 410, 411, 412, 413, 414, 415, 416, 417, 501, 503, 506]
FATAL_AFTER_RETRY = [400, 405, 406]
UNMODIFIED_STATUS = 304

#: Tags whose attributes are links: tag, attribute, type ("" by rel or as a plain link).
LINK_TAGS = [
    ("a", "href", "anchor"), ("base", "href", "base"), ("frame", "src", "frame"), ("img", "src", "image"), ("form", "action", "form"), ("link", "href", ""),
    ("body", "background", "image"), ("script", "src", "javascript"), ("applet", "codebase", "appletcodebase"), ("applet", "code", "javaapplet"),
    ("area", "href", "generic"), ("meta", "content", "generic"), ("embed", "src", "multimedia"), ("object", "data", "multimedia"), ("option", "value", "generic"),
]
SKIPPED_LINKS = ["javascript:", "mailto:", "news:"]
DIRECTORY_SORTS = ["?C=N;O=D", "?C=M;O=A", "?C=S;O=A", "?C=D;O=A", "?N=D", "?M=A", "?S=A", "?D=A"]
