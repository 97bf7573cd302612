"""Settings by preset: a child's value takes the place of its parent's, key by key."""

from __future__ import annotations

VERSION = r"(?:-?\d+(?:\.\d+){0,2})?$"
WHICH = {
    "CC": [r"cc$", r"cc1$", r"[mg]cc" + VERSION, r"clang" + VERSION],
    "CXX": [r"[mgc]\+\+" + VERSION, r"clang\+\+" + VERSION],
    "LD": [r"(?:/|-)ld$", r"ld\.lld$"],
    "AS": [r"(?:/|-)as$"],
    "AR": [r"(?:/|-)ar$"],
    "Objcopy": [r"objcopy$"],
    "MV": [r"/mv$"],
    "LN": [r"/ln$"],
    "Install": [r"/install$"],
    "CL": [r"(?:cl|CL)\.exe$"],
    "Link": [r"link\.exe$"],
    "Copy": [r"cmd\.exe$"],
}
#: The extensions that the klever presets ask for; ``Project`` builds any relation on demand.
KLEVER = ["Callgraph", "Variables", "Typedefs", "Macros", "CrossRef"]
#: An analyser's compiler isn't among the executables; ``which`` takes it as a setting.
PRESETS = {
    "base": {"which": WHICH, "types": list(WHICH), "exclude": [], "exclude_in": [r"^-$", r"/dev/null"], "exclude_out": [r"/dev/null"], "include": [], "library_dirs": ["/lib", "/usr/lib", "/usr/local/lib"], "ignore_cc1": True, "filter_by_pid": True, "extensions": []},
    "kernel": {"extends": "base", "types": ["CC", "LD", "AR", "Objcopy", "MV"], "exclude": [r"\.tmp$"], "exclude_in": [r"^-$", r"/dev/null", r"scripts/(?!mod/empty\.c)", r"kernel/.*?bounds.*?", r"arch/x86/tools/relocs", r"arch/x86/kernel/asm-offsets.c", r"\.mod\.c", r"\.tmp\w+\.s", r"\.S"], "exclude_out": [r"/dev/null", r"scripts/(?!mod/.*empty\.o)", r"\.cmd$"]},
    "busybox_linux": {"extends": "base", "exclude": [], "exclude_in": [r"\.tmp$", r"tmp\.\w+\.c$", r"tmp.*?\.c$", r"/tmp/\w+.o", r"^-$", r"/dev/null", r"built-in\.o$"], "exclude_out": [r"/dev/null", r"\.cmd$", r"tmp\.\w+"]},
    "apache_linux": {"extends": "base", "exclude": [r"/tmp/.*"], "exclude_in": [r"\.tmp$", r"tmp\.\w+\.c$", r"tmp.*?\.c$", r"^-$", r"/dev/null", r"built-in\.o$"], "exclude_out": [r"/dev/null", r"\.cmd$", r"tmp\.\w+"]},
    "klever": {"extends": "base", "extensions": KLEVER},
    "klever_linux_kernel": {"extends": "kernel", "extensions": KLEVER},
    "klever_linux_kernel_arm": {"extends": "klever_linux_kernel"},
    "klever_busybox_linux": {"extends": "busybox_linux", "extensions": KLEVER},
    "everything": {"extends": "base", "exclude_in": [], "exclude_out": []},
}


def settings(name: str = "base", **changes) -> dict:
    """A preset with its parents and ``changes`` merged; an unknown key is an error."""
    if name not in PRESETS:
        raise KeyError(f"no preset {name}")
    own = dict(PRESETS[name])
    parent = own.pop("extends", None)
    merged = (settings(parent) if parent else {}) | own | changes
    if unknown := set(changes) - set(PRESETS["base"]):
        raise KeyError(f"unknown settings {sorted(unknown)}")
    return merged
