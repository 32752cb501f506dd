"""Lists that decide which URLs, responses and paths are looked at. They are data, kept in their natural order."""

from __future__ import annotations


#: Extensions of paths that are left out.
PATH_EXTENSIONS = """
.jpg  .jpeg  .png  .gif  .bmp  .webp  .svg  .ico  .tiff  .tga  .psd  .eps  .avif  .jfif  .pjpeg  .pjp  .heic  .heif  .raw  .cr2  .nef  .arw  .dng
.pdf  .doc  .docx  .xls  .xlsx  .ppt  .pptx  .odt  .ods  .odp  .rtf  .txt  .epub  .mobi  .zip  .rar  .7z  .tar  .gz  .bz2  .xz  .lzma  .cab  .ace
.arj  .lha  .sit  .sitx  .sea  .woff  .woff2  .ttf  .otf  .eot  .pfb  .pfm  .afm  .fon  .fnt  .bdf  .pcf  .snf  .mp4  .avi  .mov  .wmv  .flv  .mkv
.webm  .m4v  .mpg  .mpeg  .3gp  .ogv  .ts  .vob  .rm  .asf  .mp3  .wav  .ogg  .aac  .flac  .wma  .m4a  .opus  .ape  .ac3  .dts  .ra  .au  .aiff  .csv
.tsv  .xml  .yaml  .yml  .toml  .ini  .sql  .db  .sqlite  .mdb  .accdb  .exe  .msi  .dmg  .pkg  .deb  .rpm  .appimage  .apk  .ipa  .jar  .war  .ear
.iso  .img  .dwg  .dxf  .step  .iges  .stl  .obj  .fbx  .dae  .3ds  .max  .blend  .ma  .mb  .c4d  .skp  .log  .bak  .tmp  .temp  .cache  .lock  .pid
""".split()


#: Parts of paths to static files.
STATIC_SEGMENTS = """
/static/  /assets/  /public/  /uploads/  /images/  /img/  /media/  /files/  /download/  /docs/  /fonts/  /css/  /styles/  /scss/  /sass/  /less/
/stylesheets/  /_next/static/  /webpack/  /node_modules/  /.well-known/  /dist/  /build/  /compiled/  /generated/  /cache/  /tmp/  /temp/  /backup/
/backups/  /logs/  /log/  /vendor/  /lib/  /libs/  /external/  /third-party/  /assets/vendor/  /assets/fonts/  /assets/images/  /wp-content/uploads/
/wp-includes/  /wp-admin/  /storage/  /var/  /home/  /usr/  /opt/  /etc/
""".split()


#: Query parameters of downloads.
DOWNLOAD_PARAMS = """
download=  attachment=  export=  format=pdf  format=excel  format=csv  format=doc  format=xls  type=pdf  type=image  output=pdf  output=excel
render=pdf  export_format=  file_type=  content_type=  mime_type=  force_download=
""".split()


#: Extensions of URLs that are not fetched.
FETCH_EXTENSIONS = """
.png  .jpg  .jpeg  .gif  .webp  .ico  .bmp  .tiff  .tif  .avif  .heic  .heif  .raw  .cr2  .nef  .arw  .dng  .psd  .ai  .eps  .jfif  .pjpeg  .pjp
.apng  .jxl  .pdf  .doc  .docx  .xls  .xlsx  .ppt  .pptx  .odt  .ods  .odp  .rtf  .epub  .mobi  .djvu  .zip  .rar  .7z  .tar  .gz  .bz2  .xz  .lzma
.cab  .ace  .arj  .lha  .sit  .sitx  .sea  .iso  .img  .dmg  .woff  .woff2  .ttf  .eot  .otf  .pfb  .pfm  .afm  .fon  .fnt  .bdf  .pcf  .snf  .mp4
.mp3  .wav  .avi  .mov  .wmv  .flv  .mkv  .webm  .m4v  .mpg  .mpeg  .3gp  .ogv  .ts  .vob  .rm  .asf  .ogg  .aac  .flac  .wma  .m4a  .opus  .ape  .ac3
.dts  .ra  .au  .aiff  .exe  .msi  .pkg  .deb  .rpm  .appimage  .apk  .ipa  .jar  .war  .ear  .db  .sqlite  .mdb  .accdb  .dwg  .dxf  .step  .iges
.stl  .obj  .fbx  .dae  .3ds  .max  .blend  .ma  .mb  .c4d  .skp  .log  .bak  .tmp  .temp  .cache  .lock  .pid
""".split()


#: Prefixes of binary data URLs.
DATA_PREFIXES = """
data:image/  data:video/  data:audio/  data:font/  data:application/pdf  data:application/zip  data:application/octet-stream
""".split()


#: Parts of URLs of binary files.
BINARY_URL_PARTS = """
/download/binary/  /downloads/files/  /media/video/  /media/audio/  /images/  /img/  /assets/img/  /static/img/  /public/img/  /pdf/  /export/pdf/
/backup/  /backups/  /fonts/  /font/  /.git/objects/  /storage/files/  /tmp/files/  /temp/files/  /cache/files/
""".split()


#: Query parameters of binary responses.
BINARY_URL_PARAMS = """
type=pdf  type=doc  type=xls  type=image  render=pdf  format=binary  output=binary  mime_type=image/  mime_type=video/  mime_type=audio/
""".split()


#: Prefixes of content types that are always read.
ALLOWED_TYPES = """
text/  application/javascript  application/json  application/xml  application/xhtml+xml  application/x-httpd-php  application/x-javascript
application/ecmascript
""".split()


#: Prefixes of content types that are not read.
BLOCKED_TYPES = """
image/png  image/jpeg  image/gif  image/webp  image/bmp  image/tiff  image/x-icon  video/  audio/  application/pdf  application/zip  application/x-rar
application/x-7z-compressed  application/x-tar  application/gzip  application/x-bzip2  application/vnd.ms-excel
application/vnd.openxmlformats-officedocument.spreadsheetml.sheet  application/msword
application/vnd.openxmlformats-officedocument.wordprocessingml.document  application/vnd.ms-powerpoint
application/vnd.openxmlformats-officedocument.presentationml.presentation  application/rtf  application/epub+zip  font/  application/font-
application/x-font-  application/vnd.ms-fontobject  application/x-executable  application/x-msdos-program  application/x-msdownload
application/vnd.android.package-archive  application/java-archive  application/x-iso9660-image  application/x-apple-diskimage
""".split()


#: Extensions that make an attachment a text.
TEXT_ATTACHMENTS = """
.txt  .html  .htm  .js  .css  .json  .xml  .csv  .tsv  .php  .asp  .aspx  .jsp  .py  .go  .java  .c  .cpp  .h  .hpp  .rb  .pl  .sh  .bat  .cmd  .sql
.yaml  .yml  .ini  .cfg  .conf  .log  .md  .rst  .tex  .r  .scala  .swift  .kt  .dart  .ts  .vue  .svelte  .jsx  .tsx
""".split()


#: Words in names of headers whose values are masked.
SENSITIVE_HEADERS = """
authorization  cookie  x-api-key  api-key  x-auth-token  auth-token  access-token  bearer  session  token  jwt  apikey  secret
""".split()


#: First bytes of binary files, in hexadecimal.
SIGNATURES = """
89504E47 FFD8FF 47494638 25504446 504B0304 52617221 377ABCAF 1F8B08 425A68 00000100 52494646 66747970 4F676753
""".split()

#: Runs of one character, and alternations, that mark a path as noise.
RUNS = [c * 4 for c in "./-=_~?!@#$%&*+|"] + ["\\" * 4] + [c * 5 for c in ":;<>[]"]
ALTERNATIONS = ["ababab", "121212", "010101", "abcabc", "123123"]

#: Parts of a path that are signatures of packed files.
PACKED_MARKS = ["PK", "Rar"]
